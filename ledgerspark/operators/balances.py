"""The balance equation that proves a statement, and the statement's summary with its fallbacks.

A statement prints beginning + credits - debits = ending, as a block of labelled figures or as a table with a
row of figures under a header. Texts become rows of lines, and all that depends on neighbouring lines is a window
over (document, line): signs that stand alone carry to the next line, labels and figures on separate lines are
paired by their place in a chain, blocks run from an opening to the first closing balance, and the rows of a table
are an island of lines with three figures or more. Only the search for a block's open signs is a helper, a block at
a time, in whole cents. Texts without any word of a balance are left out before lines are shuffled.

A null or empty text, or one without a summary, has no equation; its summary has the confidence 0. Figures of more
than sixteen digits before the point are no amounts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.money import MONEY
from .holders import first_amount, money_values

BLOCK_LINES, HEADER_LINES, MOST = 30, 3, 3**8
PART = "struct<label:string,cents:bigint,sign:int,printed:boolean>"


# -- figures ------------------------------------------------------------------------------------


def _pieces(line: Column) -> Column:
    """Every number of a line in order: array of struct(gap before it, value, counts, cents, sign)."""

    def read(x: Column) -> Column:
        def one(i: Column) -> Column:
            value, gap = F.get(x["values"], i), F.get(x["gaps"], i)
            digits = F.regexp_replace(value, r"^\$\s*", "")
            left = F.right(F.concat(F.coalesce(F.get(x["values"], i - 1), F.lit("")), gap), F.lit(1))
            front = F.regexp_replace(F.right(gap, F.lit(4)), r"[\s$(]+$", "")
            back = F.regexp_replace(F.substring(F.get(x["gaps"], i + 1), 1, 4), r"^[\s$)]+", "")
            sign = F.when(front.endswith("-"), -1).when(front.endswith("+"), 1).when(back.startswith("-"), -1).when(back.startswith("+"), 1)
            cents = (F.translate(digits, ",", "").try_cast(MONEY) * 100).cast("long")
            counts = value.rlike("[$,.]") & ~(digits.startswith(".") & left.rlike("[0-9.]")) & cents.isNotNull()
            return F.struct(gap.alias("gap"), value.alias("value"), counts.alias("counts"), cents.alias("cents"), sign.alias("sign"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(x["values"])), lambda i: i < F.size(x["values"])), one)

    clean = F.translate(T.text_of(line), L.FIGURE_MARK, " ")
    return T.let(F.struct(F.regexp_extract_all(clean, F.lit(L.PRINTED_FIGURE), 0).alias("values"), F.split(clean, L.PRINTED_FIGURE).alias("gaps")), read)


def figures(line: Column) -> Column:
    """The printed amounts of a line: array of struct(label, cents, sign). An amount has a comma, a decimal point or a dollar
    sign; its sign is 1 or -1 where one is printed beside it; its label is what stands between it and the amount before it."""

    def read(pieces: Column) -> Column:
        marked = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.when(p["counts"], L.FIGURE_MARK).otherwise(p["value"]))), "")

        def labelled(labels: Column) -> Column:
            return F.transform(
                F.filter(pieces, lambda p: p["counts"]),
                lambda p, k: F.struct(F.trim(F.regexp_replace(F.get(labels, k), "[^A-Za-z&/ ]", " ")).alias("label"), p["cents"].alias("cents"), p["sign"].alias("sign")),
            )

        return T.let(F.split(marked, L.FIGURE_MARK), labelled)

    return T.let(_pieces(line), read)


def figure_rows(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, figure_no (from 1), starts and ends (places in the line from 0), cents and sign of the amounts of lines (doc_id, line_no, line)."""
    each = lines.select("doc_id", "line_no", F.posexplode(_pieces(F.col("line"))).alias("no", "x")).select("doc_id", "line_no", "no", "x.*")
    order = Window.partitionBy("doc_id", "line_no").orderBy("no")
    ends = F.sum(F.length("gap") + F.length("value")).over(order)
    each = each.withColumns({"ends": ends.cast("long"), "figure_no": F.sum(F.col("counts").cast("long")).over(order)})
    return each.where("counts").select("doc_id", "line_no", "figure_no", (F.col("ends") - F.length("value")).alias("starts"), "ends", "cents", "sign")


def word_sign(label: Column) -> Column:
    """1 or -1 where a label has words of credits or of debits alone."""
    credit, debit = label.rlike(L.CREDIT_NAME), label.rlike(L.DEBIT_NAME)
    return F.when(credit & ~debit, 1).when(debit & ~credit, -1)


def balance_after(text: Column, carried: Column, pattern: str) -> Column:
    """Signed cents of the first amount from a balance's name on; null without a name or amount."""
    first = F.get(figures(F.regexp_extract(text, f"(?i)({pattern}.*)", 1)), F.lit(0))
    return T.let(first, lambda f: f["cents"] * F.coalesce(f["sign"], carried, F.lit(1)))


# -- lines, and labels and figures on separate lines --------------------------------------------


def summary_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, carried of texts that name a balance: clean lines; one of nothing but a sign goes, its sign carries to the next."""

    def rows(lines: Column) -> Column:
        def sign(i: Column) -> Column:
            return F.when(F.get(lines, i) == "-", -1).when(F.get(lines, i) == "+", 1)

        return F.filter(F.transform(lines, lambda x, i: F.struct(i.cast("long").alias("line_no"), x.alias("line"), sign(i - 1).alias("carried"))), lambda r: ~r["line"].isin("-", "+"))

    named = docs.where(F.col("raw_text").rlike(L.BALANCE_WORDS))
    return named.select("doc_id", F.explode(T.let(T.clean_lines(F.col("raw_text")), rows)).alias("r")).select("doc_id", "r.*")


def paired_lines(lines: DataFrame) -> DataFrame:
    """doc_id, row_no, text, carried: lines (doc_id, line_no, line, carried) with each label and the figure that stands on a line of its own put together.

    A chain is a run of lines that are a label or a figure alone, by turns, where one other line may stand between a label and
    its figure. Numbered from 0 in its chain, each even line takes the one after it.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    c, line = F.col, F.col("line")
    count, letters = F.size(figures(line)), line.rlike("[A-Za-z]")
    d = lines.withColumns({"n": count, "kind": F.when(letters & (count == 0), "label").when(~letters & (count == 1), "figure")})
    before, earlier = F.lag("kind").over(w), F.lag("kind", 2).over(w)
    follows = (before.isNotNull() & (before != c("kind"))) | ((c("kind") == "figure") & before.isNull() & F.coalesce(earlier == "label", F.lit(False)))
    d = d.withColumns({"seen": F.count("kind").over(upto), "begins": c("kind").isNotNull() & ~follows})
    d = d.withColumn("nth", F.when(c("kind").isNotNull(), c("seen") - F.last(F.when(c("begins"), c("seen")), ignorenulls=True).over(upto)))
    d = d.withColumn("taken", F.coalesce(c("nth") % 2 == 1, F.lit(False)))

    def ahead(k: int) -> Column:
        return F.lead(F.struct("line", "carried", "taken", "kind"), k).over(w)

    d = d.withColumns({"one": ahead(1), "two": ahead(2)})
    mate = F.when(c("nth").isNotNull() & c("one.taken"), c("one")).when((c("kind") == "label") & c("one.kind").isNull() & c("two.taken"), c("two"))
    d = d.where(~c("taken")).withColumn("mate", mate)
    text = F.when(c("mate").isNull(), line).when(c("kind") == "figure", F.concat(c("mate.line"), F.lit(" "), line)).otherwise(F.concat(line, F.lit(" "), c("mate.line")))
    carried = F.when(c("kind") == "figure", F.coalesce("mate.carried", "carried")).otherwise(F.coalesce("carried", "mate.carried"))
    return d.select("doc_id", F.row_number().over(w).cast("long").alias("row_no"), text.alias("text"), carried.alias("carried"))


# -- blocks and tables --------------------------------------------------------------------------


def labelled_blocks(paired: DataFrame) -> DataFrame:
    """doc_id, at, beginning, ending (cents) and parts of each block: from an opening balance to the first closing one within
    thirty rows, if no other opening stands before it; every labelled amount between them is a part."""
    w = Window.partitionBy("doc_id").orderBy("row_no")
    c, text = F.col, F.col("text")
    d = paired.withColumns({"opens": text.rlike(f"(?i){L.OPENING}"), "opening": balance_after(text, F.col("carried"), L.OPENING), "closing": balance_after(text, F.col("carried"), L.CLOSING)})
    near = w.rowsBetween(1, BLOCK_LINES - 1)
    d = d.withColumns({"next_open": F.min(F.when(c("opens"), c("row_no"))).over(near), "next_close": F.min(F.when(~c("opens") & c("closing").isNotNull(), F.struct("row_no", "closing"))).over(near)})
    ends = c("opening").isNotNull() & c("next_close").isNotNull() & (c("next_open").isNull() | (c("next_close.row_no") < c("next_open")))
    block = F.when(ends, F.struct(c("row_no").alias("at"), c("next_close.row_no").alias("until"), c("opening").alias("beginning"), c("next_close.closing").alias("ending")))
    d = d.withColumn("block", block).withColumn("block", F.last("block", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = d.where(c("row_no") < c("block.until")).select("doc_id", "block.at", "block.beginning", "block.ending", "row_no", "carried", F.posexplode(figures(text)).alias("k", "f"))
    printed = F.coalesce(c("f.sign"), c("carried"))
    part = F.struct(c("f.label").alias("label"), c("f.cents").alias("cents"), F.coalesce(printed, word_sign(c("f.label"))).cast("int").alias("sign"), printed.isNotNull().alias("printed"))
    parts = parts.where(c("f.label") != "").groupBy("doc_id", "at", "beginning", "ending").agg(F.array_sort(F.collect_list(F.struct("row_no", "k", part.alias("part")))).alias("x"))
    return parts.select("doc_id", "at", "beginning", "ending", c("x.part").cast(f"array<{PART}>").alias("parts"))


def header_signs(header: Column, columns: Column) -> Column:
    """What a header says of its columns: as many operators between its words as there are columns, else as many names of credits or
    debits between the names of the two balances; null if neither has that number."""

    def by_words(words: Column) -> Column:
        marks = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda x: x.isin("+", "-"))
        return F.transform(marks, lambda x: F.when(x == "-", -1).otherwise(1))

    opened = F.regexp_extract(header, f"(?i)^(.*?){L.OPENING}(.*)$", 2)
    front = F.regexp_extract(header, f"(?i)^(.*?){L.OPENING}.*$", 1)
    after = F.when(front.contains("|") | ~header.rlike(f"(?i){L.OPENING}"), F.regexp_extract(header, r"^[^|]*\|(.*)$", 1)).otherwise(opened)
    between = F.regexp_extract(after, f"(?i)^(.*?)(?:{L.CLOSING}.*)?$", 1)
    named = F.transform(F.regexp_extract_all(between, F.lit(rf"(?i){L.CREDIT_NAME[4:]}|{L.DEBIT_NAME[4:]}"), 0), lambda x: F.when(x.rlike(L.CREDIT_NAME), 1).otherwise(-1))
    marks = T.let(F.split(header, " "), by_words)
    return F.when(F.size(marks) == columns, marks).when(F.size(named) == columns, named)


def table_rows(lines: DataFrame) -> DataFrame:
    """doc_id, header_at, at, beginning, ending and parts of each row of figures under a header, for each line that can be its header.

    A header names the beginning and, on it or the lines before the first row of three figures (three lines at most), the ending
    balance. The rows go on as long as lines have three figures.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    c = F.col
    d = lines.withColumn("f", figures(F.col("line"))).withColumn("n", F.size("f"))
    d = d.withColumns({"at": F.row_number().over(w).cast("long"), "run": F.count(F.when(c("n") < 3, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumns({"first": F.min(F.when(c("n") >= 3, c("at"))).over(w.rowsBetween(1, HEADER_LINES)), "one": F.lead("line").over(w), "two": F.lead("line", 2).over(w)})
    header = F.concat_ws(" ", "line", F.when(c("first") - c("at") > 1, c("one")), F.when(c("first") - c("at") > 2, c("two")))
    # Heads come before the rows of their run; both lie in the document's partition, so no line is shuffled again to meet them.
    head = F.when(c("line").rlike(L.HEADER_BEGINS) & c("first").isNotNull() & header.rlike(L.HEADER_ENDS), F.struct(c("at").alias("header_at"), "first", header.alias("header")))
    told = F.array(F.struct((c("run") + c("first") - c("at") - 1).alias("run"), head.alias("head"), F.lit(False).alias("is_row")), F.struct("run", F.lit(None).alias("head"), (c("n") >= 3).alias("is_row")))
    d = d.select("doc_id", "at", "f", "n", F.explode(told).alias("t")).select("doc_id", "at", "f", "n", "t.*").where("is_row or head is not null")
    seen = Window.partitionBy("doc_id", "run").orderBy("at", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = d.withColumn("heads", F.collect_list("head").over(seen)).where("is_row").select("doc_id", "at", "f", "n", F.explode("heads").alias("h")).select("doc_id", "at", "f", "n", "h.*").where("at >= first")
    rows = rows.withColumn("signs", header_signs(c("header"), c("n") - 2))

    def signed(f: Column) -> Column:
        return f["cents"] * F.coalesce(f["sign"], F.lit(1))

    parts = F.transform(F.slice("f", F.lit(2), c("n") - 2), lambda f, k: F.struct(F.concat(F.lit("column "), (k + 1).cast("string")).alias("label"), f["cents"].alias("cents"), F.get("signs", k).alias("sign"), c("signs").isNotNull().alias("printed")))
    return rows.select("doc_id", "header_at", "at", signed(F.get("f", F.lit(0))).alias("beginning"), signed(F.get("f", c("n") - 1)).alias("ending"), parts.cast(f"array<{PART}>").alias("parts"))


# -- signs --------------------------------------------------------------------------------------


def _sums(choices: list[tuple[int, ...]], cents: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Credits and debits of every choice of signs; the first part's varies fastest."""
    plus, minus = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for some, amount in zip(choices, cents, strict=True):
        p, m = (np.array([amount if s == want else 0 for s in some], np.int64) for want in (1, -1))
        plus, minus = np.add.outer(p, plus).ravel(), np.add.outer(m, minus).ravel()
    return plus, minus


def _chosen(number: int, choices: list[tuple[int, ...]]) -> list[int]:
    out = []
    for some in choices:
        number, i = divmod(number, len(some))
        out.append(some[i])
    return out


def _few(choices: list[tuple[int, ...]]) -> bool:
    return np.prod([float(len(x)) for x in choices]) <= MOST


def solve_signs(beginning: int, parts: list[tuple[int, int | None, bool]], ending: int) -> tuple[list[int], bool]:
    """Signs of parts (cents, sign or None, printed) and whether they prove the ending to a cent.

    First named parts keep their sign and only unnamed ones are open (credit, debit or neither); then one that is named but not
    printed may also be neither. The least movement wins; two different answers that move as much prove nothing. Without a proof,
    the signs that come closest, the first of equals. Credits and debits of all choices are summed a part at a time.
    """
    cents, free = [p[0] for p in parts], (1, -1, 0)
    strict = [free if sign is None else (sign,) for _, sign, _ in parts]
    loose = [free if sign is None else (sign,) if printed else (sign, 0) for _, sign, printed in parts]
    for choices in (strict, loose):
        if not _few(choices):
            continue
        plus, minus = _sums(choices, cents)
        good = np.flatnonzero(np.abs(beginning + plus - minus - ending) <= 1)
        if len(good):
            moved = (plus + minus)[good]
            best = good[moved == moved.min()]
            if len(set(zip(plus[best].tolist(), minus[best].tolist(), strict=True))) == 1:
                return _chosen(int(best[0]), choices), True
    if not _few(strict):
        return [sign or 0 for _, sign, _ in parts], False
    plus, minus = _sums(strict, cents)
    return _chosen(int(np.argmin(np.abs(beginning + plus - minus - ending))), strict), False


def solve_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (beginning, ending, parts) with signs, an array of int beside parts, and verified."""

    @F.arrow_udf("struct<signs:array<int>,verified:boolean>")
    def solve(beginning: pa.Array, ending: pa.Array, parts: pa.Array) -> pa.Array:
        each = zip(beginning.to_pylist(), ending.to_pylist(), parts.to_pylist(), strict=True)
        solved = [solve_signs(b, [(p["cents"], p["sign"], p["printed"]) for p in some], e) for b, e, some in each]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in solved], pa.list_(pa.int32())), pa.array([x[1] for x in solved], pa.bool_())], ["signs", "verified"])

    return blocks.withColumn("s", solve("beginning", "ending", "parts")).select(*blocks.columns, "s.signs", "s.verified")


def summary_blocks(docs: DataFrame) -> DataFrame:
    """Every equation of texts (doc_id, raw_text), solved: doc_id, block_no, layout, beginning, ending, deposits, withdrawals, difference,
    verified, evidence, components. Labelled blocks in order, then the proven rows of the first header that has any."""
    lines, c = summary_lines(docs), F.col
    blocks = labelled_blocks(paired_lines(lines)).select("doc_id", F.lit("labelled_block").alias("layout"), F.lit(0).cast("long").alias("header_at"), "at", "beginning", "ending", "parts")
    tables = table_rows(lines).select("doc_id", F.lit("column_table").alias("layout"), "header_at", "at", "beginning", "ending", "parts")
    solved = solve_blocks(blocks.unionByName(tables))
    doc = Window.partitionBy("doc_id")
    header = F.min(F.when((c("layout") == "column_table") & c("verified"), c("header_at"))).over(doc)
    solved = solved.withColumn("header", header).where((c("layout") == "labelled_block") | (c("verified") & (c("header_at") == c("header"))))
    signed = F.zip_with("parts", "signs", lambda p, s: F.struct(p["label"].alias("label"), (p["cents"] * s).alias("cents")))

    def total(sign: int) -> Column:
        return F.aggregate("components", F.lit(0).cast("long"), lambda a, x: a + F.when(x["cents"] * sign > 0, x["cents"] * sign).otherwise(0))

    d = solved.withColumn("components", signed).withColumns({"deposits": total(1), "withdrawals": total(-1)})
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(c("layout").desc(), "at"))
    money = {x: (c(x) / 100).alias(x) for x in ("beginning", "ending", "deposits", "withdrawals")}
    difference = ((c("beginning") + c("deposits") - c("withdrawals") - c("ending")) / 100).alias("difference")
    evidence = F.concat(F.when(c("verified"), "Verified ").otherwise("Unproven "), F.translate("layout", "_", " ")).alias("evidence")
    parts = F.transform("components", lambda x: F.struct(x["label"].alias("label"), (x["cents"] / 100).alias("amount"))).alias("components")
    return d.select("doc_id", number.alias("block_no"), "layout", *money.values(), difference, "verified", evidence, parts)


def pick_equation(blocks: DataFrame) -> DataFrame:
    """One equation per document: a proven one with the largest movement (blocks before tables, the first on a tie), else the first."""
    movement = F.when(F.col("verified"), F.col("deposits") + F.col("withdrawals")).otherwise(F.lit(0.0))
    order = Window.partitionBy("doc_id").orderBy(F.col("verified").desc(), movement.desc(), "block_no")
    proven = F.sum(F.col("verified").cast("long")).over(Window.partitionBy("doc_id", "layout"))
    out = blocks.withColumns({"place": F.row_number().over(order), "accounts": proven})
    return out.where("place = 1").drop("place")


# -- the summary --------------------------------------------------------------------------------


def summary_evidence(docs: DataFrame) -> DataFrame:
    """doc_id and, of texts (doc_id, raw_text), what lines tell of deposits and the ending balance apart from an equation: columns
    online, posted and dated, each a struct(deposits, ending) or null, in cents.

    A line that counts comes with the three lines before and the two after it, cut from the array of lines inside the row, so lines
    aren't shuffled: partial sums are.
    """

    def near(lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: F.coalesce(F.lower(F.get(lines, i)).rlike(L.SUMMARY_LINE), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.alias("no"), F.get(lines, i).alias("line"), F.array(*[F.get(lines, i - k) for k in (1, 2, 3)]).alias("above"), F.array(*[F.get(lines, i + k) for k in (1, 2)]).alias("below")))

    text, c = F.lower(T.text_of(F.col("raw_text"))), F.col
    d = docs.select("doc_id", text.contains(L.ONLINE_HEADS[0]).alias("has_online"), text.contains(L.ONLINE_HEADS[1]).alias("has_posted"), F.explode(T.let(T.clean_lines(F.col("raw_text")), near)).alias("x"))
    low = F.lower("line")
    d = d.select("doc_id", "has_online", "has_posted", "x.*").withColumn("all", F.transform(money_values(c("line")), F.abs))
    d = d.withColumn("some", F.filter("all", lambda v: ~v.between(2020, 2030)))

    def first_near(lines: Column) -> Column:
        return F.get(F.array_compact(F.transform(lines, lambda x: first_amount(money_values(F.coalesce(x, F.lit(""))))), ), F.lit(0))

    def last(condition: Column, value: Column) -> Column:
        """The value on the last line for which the condition holds, null though it may be."""
        return F.max(F.when(condition, F.struct("no", value.alias("v"))))["v"]

    def second_last(values: Column) -> Column:
        return F.get(values, F.size(values) - 2)

    is_totals = (low == "totals") | low.startswith("totals ")
    is_present = low.startswith("current posted balance") | low.startswith("ending collected balance")
    is_credit = low.rlike(L.POSTED_CREDIT) & (F.size("some") >= 2) & ~c("line").rlike(r"[—–-]\s*$")
    dated = low.rlike(L.DATED_LINE)
    is_deposit = dated & low.rlike(L.DATED_CREDIT) & ~low.rlike(r"ending balance|balance forward") & (F.size("some") >= 2)
    is_ending = (low.rlike(r"\bending balance\b") & (F.size("some") >= 1)) | (dated & (F.size("some") >= 2))
    g = d.groupBy("doc_id").agg(
        last(c("has_online") & is_totals & (F.size("all") >= 2), F.get("all", F.lit(0))).alias("online_deposits"),
        last(c("has_online") & is_present, F.coalesce(F.get("all", F.lit(0)), first_near(c("below")))).alias("online_ending"),
        F.sum(F.when(c("has_posted") & is_credit, second_last(c("some")))).alias("posted_deposits"),
        last(c("has_posted") & low.contains("present balance"), F.coalesce(F.get("some", F.lit(0)), first_near(c("above")))).alias("posted_ending"),
        F.sum(F.when(is_deposit, second_last(c("some")))).alias("dated_deposits"),
        last(is_ending, F.get("some", F.size("some") - 1)).alias("dated_ending"),
    )

    def both(kind: str) -> Column:
        a, b = c(f"{kind}_deposits").cast("double"), c(f"{kind}_ending").cast("double")
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("deposits"), b.alias("ending"))).alias(kind)

    return g.select("doc_id", *[both(x) for x in ("online", "posted", "dated")])


def scanned_summary(text: Column, filename: Column) -> Column:
    """struct(deposits, ending, evidence) from the damaged text of a scan, by the rules of two banks; null if neither finds an amount."""
    low, compact = F.lower(T.text_of(text)), T.clean_space(text)

    def number(value: Column) -> Column:
        return F.regexp_replace(value, r"[,\s]", "").try_cast(MONEY).cast("double")

    def found(deposits: Column, ending: Column, evidence: str) -> Column:
        return F.when(deposits.isNotNull() | ending.isNotNull(), F.struct(deposits.alias("deposits"), ending.alias("ending"), F.lit(evidence).alias("evidence")))

    farmers = found(number(F.regexp_extract(text, L.SCANNED_CREDITS, 1)), number(F.regexp_extract(text, L.SCANNED_ENDING, 1)), "Farmers OCR summary")
    deposits = F.array_max(F.filter(F.transform(F.regexp_extract_all(compact, F.lit(L.SCANNED_DEPOSITS), 1), number), lambda v: (v >= 1000) & (v < 10_000_000)))
    balances = F.transform(F.filter(T.clean_lines(text), lambda x: x.rlike(L.SCANNED_ACCOUNT)), lambda x: F.filter(F.transform(money_values(x), F.abs), lambda v: v.between(100, 999_999.99) & ~v.between(2020, 2030)))
    line = F.get(F.filter(balances, lambda v: F.size(v) > 0), F.lit(0))
    ending = F.coalesce(T.let(line, lambda v: F.get(v, F.size(v) - 1)).cast("double"), number(F.regexp_extract(compact, L.SCANNED_TOTAL, 1)))
    members = found(deposits, ending, "IMCU OCR summary")
    named = low.contains("farmers") | F.lower(T.text_of(filename)).contains("farmers")
    return F.coalesce(F.when(named, farmers), F.when(low.rlike(L.SCANNED_MEMBERS), members))


def statement_summary(docs: DataFrame, with_equation: bool = False) -> DataFrame:
    """A row per document (doc_id, raw_text, filename, used_ocr): beginning, deposits, withdrawals, ending, difference, confidence, evidence.

    The strongest evidence wins: a proven equation (99), an online printout's totals (94) or posted credits (88), summed dated rows
    (78), an unproven equation (40), nothing (0). Of a scan without a proven equation, what the scan rules find replaces
    deposits and ending, at a confidence of 95 or more. with_equation: pick_equation's figures beside it as a struct, `equation`.
    """
    e = pick_equation(summary_blocks(docs)).select("doc_id", F.struct("beginning", "deposits", "withdrawals", "ending", "difference", "verified", "evidence").alias("e"))
    d = docs.select("doc_id", F.when(F.coalesce("used_ocr", F.lit(False)), scanned_summary(F.col("raw_text"), F.col("filename"))).alias("scan"))
    d = d.join(e, "doc_id", "left").join(summary_evidence(docs), "doc_id", "left")
    c, none = F.col, F.lit(None).cast("double")

    def row(confidence: int, evidence: Column, deposits: Column, ending: Column, beginning: Column = none, withdrawals: Column = none, difference: Column = none) -> Column:
        return F.struct(beginning.alias("beginning"), deposits.alias("deposits"), withdrawals.alias("withdrawals"), ending.alias("ending"), difference.alias("difference"), F.lit(confidence).cast("long").alias("confidence"), evidence.alias("evidence"))

    def equation(confidence: int) -> Column:
        return row(confidence, c("e.evidence"), c("e.deposits"), c("e.ending"), c("e.beginning"), c("e.withdrawals"), c("e.difference"))

    best = F.when(c("e.verified"), equation(99))
    for kind, confidence, evidence in L.SUMMARY_EVIDENCE:
        best = best.when(c(kind).isNotNull(), row(confidence, F.lit(evidence), c(f"{kind}.deposits"), c(f"{kind}.ending")))
    best = best.when(c("e").isNotNull(), equation(40)).otherwise(row(0, F.lit("No summary found"), none, none))
    d = d.withColumn("s", best).withColumn("scan", F.when(~F.coalesce(c("e.verified"), F.lit(False)), c("scan")))
    return d.select(
        "doc_id", "s.beginning", F.coalesce("scan.deposits", "s.deposits").alias("deposits"), "s.withdrawals", F.coalesce("scan.ending", "s.ending").alias("ending"), "s.difference",
        F.when(c("scan").isNotNull(), F.greatest(c("s.confidence"), F.lit(95))).otherwise(c("s.confidence")).alias("confidence"), F.coalesce("scan.evidence", "s.evidence").alias("evidence"), *([c("e").alias("equation")] if with_equation else []),
    )

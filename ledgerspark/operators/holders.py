"""What a statement says of its holder: company and trade name, mailing address; and the amounts near a line.

Documents have doc_id, raw_text and what a function names. Texts become rows of lines; each rule is a column over
one line, and a document's answer is the least line (and rule) that has one, so no text is walked line by line.
Documents without an answer keep their row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.money import MONEY


def clean_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(T.clean_space(value), r"[,;]+$", ""))


def name_lines(docs: DataFrame) -> DataFrame:
    """docs' columns but raw_text, with line_no (from 1) and line; one row without a line for an empty text."""
    lines = F.filter(F.transform(F.split(T.text_of(F.col("raw_text")), r"\r?\n"), clean_name), lambda x: x != "")
    return docs.select(*[c for c in docs.columns if c != "raw_text"], F.posexplode_outer(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def looks_like_address(name: Column) -> Column:
    street = name.rlike(r"^\s*\d") & name.rlike(L.STREET_TYPE)
    return name.rlike(L.ADDRESS_START) | ~name.rlike(L.ENTITY_SUFFIX) & (street | name.rlike(L.TOWN_END) | name.rlike(r"^\s*\d+\s+\w+"))


def plausible(name: Column) -> Column:
    """Whether a line can be a holder's name."""
    ok = F.length(name).between(3, 80) & name.rlike("[A-Za-z]{2}") & ~name.rlike(L.POSTING_DATE) & ~name.rlike(L.STATEMENT_FURNITURE) & ~looks_like_address(name)
    return F.coalesce(ok, F.lit(False))


def same_as_bank(name: Column, bank: Column) -> Column:
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (name, bank))
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))


def company_names(docs: DataFrame) -> DataFrame:
    """doc_id, legal_name, dba and evidence of statements (doc_id, raw_text, bank): a label, then a line near the top that
    ends in a legal suffix, then one that has other text after it, then a trade name alone."""
    line, head = F.col("line"), F.col("line_no") <= L.HOLDER_LINES

    def own(name: Column) -> Column:
        return plausible(name) & ~same_as_bank(name, F.col("bank"))

    labels = F.filter(F.array(*[clean_name(F.regexp_extract(line, p + r"(.+)", 1)) for p in L.HOLDER_LABELS]), own)
    before = F.trim(F.regexp_extract(line, rf"(?i)^(.*?\b(?:{L.ENTITY_WORDS})\b\.?)", 1))
    words = F.split(before, r"\s+")
    short = (before != line) & F.size(words).between(2, 6) & F.forall(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike("^[A-Z0-9]"))
    trade = clean_name(F.regexp_extract(line, L.TRADE_NAME, 1))
    found = {
        "labelled": F.when(line.rlike("|".join(f"(?:{p})" for p in L.HOLDER_LABELS)), F.get(labels, F.lit(0))),
        "entity_suffix": F.when(head & line.rlike(L.ENTITY_SUFFIX) & own(line), line),
        "entity_suffix_split_row": F.when(head & short & own(before), before),
        "dba": F.when(head & line.rlike(L.TRADE_NAME) & plausible(trade), trade),
    }
    lines = name_lines(docs.select("doc_id", "raw_text", "bank")).select("doc_id", "line_no", *[x.alias(n) for n, x in found.items()])
    first = lines.groupBy("doc_id").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in found])
    kinds = list(found)[:3]
    evidence = functools.reduce(lambda rest, n: F.when(F.col(n).isNotNull(), n).otherwise(rest), reversed(kinds), F.when(F.col("dba").isNotNull(), "dba_only").otherwise("none"))
    return first.select("doc_id", T.strip_noise_prefix(F.coalesce(*kinds)).alias("legal_name"), "dba", evidence.alias("evidence"))


def holder_addresses(docs: DataFrame) -> DataFrame:
    """doc_id, street, town, state, postcode and full of statements (doc_id, raw_text, name): below the name's first line,
    within ten lines, a street (or a post box where no street stands before it) and then a town."""
    lines = docs.select("doc_id", F.lower(T.clean_space(F.col("name"))).alias("name"), F.posexplode(T.clean_lines(F.col("raw_text"))).alias("no", "line"))
    start = lines.where((F.col("name") != "") & F.lower("line").contains(F.col("name"))).groupBy("doc_id").agg(F.min("no").alias("start"))
    line = F.col("line")
    street = F.regexp_extract(F.regexp_replace(line, r"^\d{5,}\s+(\d+\s+\D)", "$1"), L.STREET, 1)
    near = lines.join(start, "doc_id").where((F.col("no") > F.col("start")) & (F.col("no") <= F.col("start") + L.ADDRESS_REACH) & ~line.rlike(L.NO_ADDRESS))
    near = near.select("doc_id", "no", "line", F.when(street != "", T.clean_space(street)).alias("street"), *[T._group(line, L.TOWN_LINE, i).alias(n) for i, n in ((1, "town"), (2, "state"), (3, "postcode"))])
    doc = Window.partitionBy("doc_id")  # ten lines at most
    near = near.withColumns({"street_no": F.min(F.when(F.col("street").isNotNull(), F.col("no"))).over(doc), "first_street": F.min_by("street", F.when(F.col("street").isNotNull(), F.col("no"))).over(doc)})
    early = F.col("street_no").isNull() | (F.col("no") < F.col("street_no"))
    box = F.when(line.rlike(L.POST_BOX) & early, F.col("no"))
    near = near.withColumns({"box_no": F.min(box).over(doc), "box": F.min_by("line", box).over(doc)})
    after = F.col("no") > F.col("street_no")
    where = F.when(after, F.col("first_street")).when(early & (F.col("box_no") <= F.col("no")), F.col("box"))
    end = near.where(F.col("town").isNotNull() & where.isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct(where.alias("street"), T.clean_space(F.col("town")).alias("town"), F.upper("state").alias("state"), "postcode"), "no").alias("x"))
    out = docs.select("doc_id").join(end, "doc_id", "left").select("doc_id", "x.*")
    return out.withColumn("full", F.concat(F.col("street"), F.lit(", "), F.col("town"), F.lit(", "), F.col("state"), F.lit(" "), F.col("postcode")))


def money_values(line: Column) -> Column:
    """The figures of a line in order, ARRAY<DECIMAL>: negative with a minus, or both parentheses, within three characters;
    long runs of bare digits and figures over fifty million are left out."""

    def read(found: Column) -> Column:
        def one(i: Column) -> Column:
            text, gaps = F.get(found["values"], i), found["gaps"]
            left = F.concat(F.coalesce(F.get(found["values"], i - 1), F.lit("")), F.get(gaps, i))
            right = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found["values"], i + 1), F.lit("")))
            chunk = F.concat(F.right(left, F.lit(3)), text, F.substring(right, 1, 3))
            value = F.regexp_replace(text, r"[^0-9.]", "").try_cast(MONEY)
            negative = chunk.contains("-") | chunk.contains("(") & chunk.contains(")")
            plain = (F.length(F.regexp_replace(text, r"\D", "")) >= 7) & ~text.rlike("[,$.]")
            return F.when(~plain & (value <= 50_000_000), F.when(negative, -value).otherwise(value))

        return F.array_compact(F.transform(F.filter(F.sequence(F.lit(0), F.size(found["values"])), lambda i: i < F.size(found["values"])), one))

    pair = F.struct(F.regexp_extract_all(line, F.lit(f"({L.FIGURE})")).alias("values"), F.split(line, L.FIGURE).alias("gaps"))
    return F.element_at(F.transform(F.array(pair), read), 1)


def first_amount(values: Column) -> Column:
    """The first figure without its sign; figures from 2020 to 2030 may be years and don't count."""
    return F.abs(F.get(F.filter(values, lambda v: ~F.abs(v).between(2020, 2030)), F.lit(0)))


def amounts_near(lines: DataFrame, ahead: int = 4, back: int = 7) -> DataFrame:
    """lines (doc_id, line_no, line) with amounts, next_amount and next_line (within `ahead` lines), previous_amount and previous_line."""
    d = lines.withColumn("amounts", money_values(F.col("line")))
    seen = F.when(first_amount(F.col("amounts")).isNotNull(), F.struct(first_amount(F.col("amounts")).alias("amount"), "line_no"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    d = d.withColumns({"next": F.first(seen, ignorenulls=True).over(w.rowsBetween(1, ahead)), "previous": F.last(seen, ignorenulls=True).over(w.rowsBetween(-back, -1))})
    return d.select(*lines.columns, "amounts", *[F.col(f"{side}.{a}").alias(f"{side}_{b}") for side in ("next", "previous") for a, b in (("amount", "amount"), ("line_no", "line"))])

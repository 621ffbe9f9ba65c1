"""Statement text to ledger rows.

Lines are numbered within a document; headings, totals and starts of rows are marked by
built-in expressions; windows over (document, line) carry the section down and number the rows; one
grouping per row puts wrapped lines together. Lines after a heading or total belong to no row until
the next start. A null text has no lines.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.money import MONEY

DATE = r"(\d{1,2})[/\-.](\d{1,2})(?:[/\-.](\d{2,4}))?"
LEADING = rf"^\s*{DATE}\s+(.*)$"
TRAILING = rf"^(.*?)\s{DATE}\s+({T.AMOUNT})\s*$"
CHECK = r"(?i)\b(?:check|cheque|chk)\s*#?\s*(\d{3,6})\b"
CHECK_FIRST = r"^#(\d{3,6})\b"


def explode_lines(docs: DataFrame, clean: bool = True, text_col: str = "raw_text") -> DataFrame:
    """doc_id, line_no (from 1), line. Clean lines have single spaces and aren't empty; raw ones only aren't blank."""
    lines = T.clean_lines(F.col(text_col)) if clean else F.split(T.text_of(F.col(text_col)), r"\r?\n")
    out = docs.select("doc_id", F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))
    return out if clean else out.where(F.trim("line") != "")


def line_section(line: Column) -> Column:
    """ignore, credit or debit for a short heading without an amount, else null."""
    trimmed = F.trim(line)
    kind = functools.reduce(lambda rest, s: F.when(trimmed.rlike(s[1]), s[0]).otherwise(rest), reversed(L.SECTIONS), F.lit(None).cast("string"))
    return F.when((F.length(trimmed) <= L.HEADING_LENGTH) & ~line.rlike(r"[\d,]+\.\d{2}"), kind)


def amounts_of(value: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(value, F.lit(f"({T.AMOUNT})")), T.parse_amount), lambda x: x.isNotNull())


def resolve_direction(amount: Column, description: Column, section: Column) -> Column:
    """struct(direction, source): sign, then a DR or CR tag, then the section, then keywords."""
    def pair(direction: str, source: str) -> Column:
        return F.struct(F.lit(direction).alias("direction"), F.lit(source).alias("source"))

    return (
        F.when(amount.isNull(), pair("needs_review", "none")).when(amount < 0, pair("debit", "sign"))
        .when(description.rlike(r"\bDR\b"), pair("debit", "tag")).when(description.rlike(r"\bCR\b"), pair("credit", "tag"))
        .when(section == "credit", pair("credit", "section")).when(section == "debit", pair("debit", "section"))
        .when(description.rlike(L.CREDIT_WORDS), pair("credit", "keyword")).when(description.rlike(L.DEBIT_WORDS), pair("debit", "keyword"))
        .otherwise(pair("needs_review", "none"))
    )


def parse_transactions(docs: DataFrame, statement_year: int | str = "statement_year") -> DataFrame:
    """Ledger rows of statement texts (doc_id, raw_text). Dates without a year take statement_year, a number or a column of docs."""
    year = F.col(statement_year) if isinstance(statement_year, str) else F.lit(statement_year)
    lines = docs.select("doc_id", year.cast("string").alias("year"), F.posexplode(F.split(T.text_of(F.col("raw_text")), r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("heading", line_section(F.col("line")))
    lines = lines.withColumn("section", F.last("heading", ignorenulls=True).over(upto))
    closes = F.col("heading").isNotNull() | F.col("line").rlike(L.TOTAL_LINE)
    reads = ~closes & (F.coalesce("section", F.lit("")) != "ignore")
    lead, trail = F.col("line").rlike(LEADING), F.col("line").rlike(TRAILING)
    lines = lines.withColumns({"starts": reads & (lead | trail), "lead": lead, "reads": reads, "closes": closes})
    lines = lines.withColumn("txn_no", F.sum(F.col("starts").cast("long")).over(upto))
    lines = lines.withColumn("open", F.last(F.when(F.col("starts"), True).when(F.col("closes"), False), ignorenulls=True).over(upto))
    rows = lines.where("reads and open")

    line = F.col("line")
    rest = F.when(F.col("starts") & F.col("lead"), F.regexp_extract(line, LEADING, 4)).when(F.col("starts"), F.regexp_extract(line, TRAILING, 1)).otherwise(line)
    found = F.when(F.col("starts") & ~F.col("lead"), F.array(T.parse_amount(F.regexp_extract(line, TRAILING, 5)))).otherwise(amounts_of(rest))
    words = F.trim(F.regexp_replace(F.regexp_replace(rest, T.AMOUNT, ""), r"\s{2,}", " "))
    follows = (words != "") & ~words.rlike(r"(?i)^(page \d+|continued|total|subtotal)") & (F.length(words) <= 120)

    def date_part(n: int) -> Column:
        return F.when(F.col("lead"), F.regexp_extract(line, LEADING, n)).otherwise(F.regexp_extract(line, TRAILING, n + 1))

    given = date_part(3)
    date = T.iso(F.when(given == "", F.col("year").try_cast("int")).otherwise(T.full_year(given, 50)), date_part(1).try_cast("int"), date_part(2).try_cast("int"))
    rows = rows.select(
        "doc_id", "txn_no", "line_no", F.when(F.col("starts"), date).alias("date_text"), F.when(F.col("starts"), F.col("section")).alias("section"), found.alias("amounts"),
        F.when(F.col("starts") | follows, words).alias("words"), F.when(F.col("starts") | follows, line).alias("source"),
    )
    g = rows.groupBy("doc_id", "txn_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "date_text", "section", "amounts", "words", "source"))).alias("parts"))
    amounts = F.flatten(F.col("parts.amounts"))
    g = g.select("doc_id", "txn_no", F.get("parts", F.lit(0))["date_text"].alias("date_text"), F.get("parts", F.lit(0))["section"].alias("section"), amounts.alias("amounts"),
                 F.trim(F.regexp_replace(F.array_join(F.array_compact("parts.words"), " "), r"\s{2,}", " ")).alias("description"), F.array_compact("parts.source").alias("source_lines"))
    g = g.withColumn("signed", F.get("amounts", F.lit(0)))
    g = g.withColumn("d", resolve_direction(F.col("signed"), F.col("description"), F.col("section")))
    check = F.coalesce(*[F.when(F.regexp_extract("description", p, 1) != "", F.regexp_extract("description", p, 1)) for p in (CHECK, CHECK_FIRST)])
    g = g.withColumn("check_number", F.when(F.col("d.direction") == "debit", check))
    again = F.row_number().over(Window.partitionBy("doc_id", "check_number").orderBy("txn_no"))
    g = g.withColumn("again", again).where("check_number is null or again = 1")
    uncertain = F.col("signed").isNull() | (F.col("d.direction") == "needs_review")
    return g.select(
        "doc_id", F.concat(F.lit("txn_"), F.col("txn_no").cast("string")).alias("txn_id"), "txn_no", "date_text", F.to_date(F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd"))).alias("txn_date"),
        "description", F.array_join("source_lines", " | ").alias("raw_description"), "check_number", F.abs("signed").cast(MONEY).alias("amount"), F.col("d.direction").alias("direction"),
        F.col("d.source").alias("direction_source"), "section", F.when(F.size("amounts") >= 2, F.get("amounts", F.size("amounts") - 1)).cast(MONEY).alias("running_balance"), "source_lines",
        F.when(F.col("signed").isNull(), "low").when(F.col("d.direction") == "needs_review", "medium").otherwise("high").alias("confidence"), uncertain.alias("review_flag"),
    )


def render_statements(txns: DataFrame) -> DataFrame:
    """doc_id, raw_text: credits and debits of ledger rows as a statement prints them, in row order; other rows are left out."""
    line = F.concat_ws(" ", F.date_format("txn_date", "MM/dd/yyyy"), "description", F.col("amount").cast("string"))
    g = txns.where(F.col("direction").isin("credit", "debit")).groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("direction") == k, F.struct("txn_no", line.alias("line"))))).alias(k) for k in ("credit", "debit")])
    body = F.concat(F.array(F.lit("Account Statement"), F.lit("Deposits and other credits")), F.col("credit.line"), F.array(F.lit("Total deposits"), F.lit("Withdrawals and other debits")), F.col("debit.line"), F.array(F.lit("Total withdrawals")))
    return g.select("doc_id", F.array_join(body, "\n").alias("raw_text"))

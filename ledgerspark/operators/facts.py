"""Document facts in one job: texts in, one row a document out; and their recompute after corrections.

Texts are written once in buckets of the document with what columns alone can tell (kind, bank, account, period), so each
rule that needs lines, windows or groupings, and each join of their results, finds a document's rows where they are:
after that one exchange no other is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import kept
from . import analytics, applications, balances, holders, statements, verdicts

LEDGER = ("txn_count", "flagged_count", "gross_deposits", "true_revenue", "total_credits", "total_debits", "event_count", "position_count", "position_review_count")


def told_by_text(docs: DataFrame, this_year: int) -> DataFrame:
    """docs (doc_id, arrival_no, filename, raw_text, used_ocr, page_count, pages_read) with the columns that need no other row."""
    text, filename, c = F.col("raw_text"), F.col("filename"), F.col
    kind = T.document_kind(text)
    d = docs.select("doc_id", "arrival_no", "filename", "raw_text", F.coalesce("used_ocr", F.lit(False)).alias("used_ocr"), F.coalesce(c("pages_read") < c("page_count"), F.lit(False)).alias("truncated"), kind.alias("first_type"))
    d = d.withColumn("contact_sheet", (c("first_type") != "bank_statement") & T.is_contact_sheet(text))
    d = d.withColumn("is_form", (c("first_type") == "application") | c("contact_sheet"))
    statement = ~c("is_form")
    d = d.withColumns({
        "is_mtd": statement & T.is_mtd(text, filename), "needs_text": T.needs_ocr(text), "bank": F.when(statement, T.bank(text, filename)), "account": F.when(statement, T.account_number(text)),
        "period": F.when(statement, T.statement_period(text, filename, this_year)),
    })
    return d.withColumn("statement_year", F.coalesce(F.substring("period.end", 1, 4).try_cast("int"), F.lit(this_year)))


def document_facts(told: DataFrame, this_year: int = 2026) -> DataFrame:
    """One row per document of told_by_text's rows, best read from buckets of doc_id (doc_id is unique).

    A statement has its summary, ledger totals, reconciliation and confidence; a form its fields. Funders read from raw lines
    alone have rows of their own (advance_positions_from_lines) and aren't counted here."""
    c = F.col
    stmts, forms = told.where(~c("is_form")), told.where(c("is_form"))
    names = holders.company_names(told.select("doc_id", "raw_text", "bank"))
    places = holders.holder_addresses(stmts.select("doc_id", "raw_text").join(names.select("doc_id", c("legal_name").alias("name")), "doc_id"))
    summary = balances.statement_summary(stmts.select("doc_id", "raw_text", "filename", "used_ocr"), with_equation=True)
    ledger = analytics.ledger_totals(statements.parse_transactions(stmts.select("doc_id", "raw_text", "statement_year")))
    fields = applications.extract_application(forms.select("doc_id", "raw_text", "filename"), this_year)
    f = told.select("doc_id", "arrival_no", "filename", "first_type", "contact_sheet", "is_form", "is_mtd", "used_ocr", "needs_text", "truncated", "bank", "account", "period", "raw_text")
    told_by_summary = [c("beginning").alias("opening"), "ending", c("deposits").alias("summary_deposits"), c("withdrawals").alias("summary_withdrawals"), c("confidence").alias("summary_confidence")]
    equation = [c(f"equation.{x}").alias(f"eq_{x}") for x in ("beginning", "ending", "deposits", "withdrawals", "difference")]
    f = f.join(summary.select("doc_id", *told_by_summary, c("equation.verified").alias("verified"), *equation), "doc_id", "left")
    f = f.withColumn("quality", T.text_quality(c("raw_text"), c("is_form"), F.coalesce("verified", F.lit(False)))).drop("raw_text")
    f = f.join(ledger, "doc_id", "left").fillna(0, [x for x in LEDGER if not x.startswith("total_")]).withColumns({x: F.coalesce(x, F.lit(0)) for x in ("total_credits", "total_debits")})
    checked = analytics.reconcile_totals(f.where(~c("is_form")))
    f = f.join(checked.select("doc_id", "reconciles", c("reason").alias("reconcile_reason"), c("difference").alias("reconcile_difference")), "doc_id", "left")
    f = f.join(names.select("doc_id", "legal_name", "dba", "evidence"), "doc_id", "left").join(places.select("doc_id", c("full").alias("holder_address")), "doc_id", "left")
    f = f.join(fields.select("doc_id", "owner", c("company").alias("form_company"), "any_company", c("address").alias("form_address"), "dob", "start_date", "app_date", "ein", "ssn_mask", "stated_revenue", "phones", "emails", "fields_found"), "doc_id", "left")
    return concluded(f)


def concluded(f: DataFrame) -> DataFrame:
    """Verdicts from a document's joined facts: type, trust, revenue, confidence, review items and status."""
    c, no = F.col, F.lit(False)

    def is_true(x: Column) -> Column:
        return F.coalesce(x, no)

    form = c("is_form")
    by_rows = ~c("truncated") & (c("true_revenue") > 0)
    trusted = c("contact_sheet") | c("quality.trusted")
    identity = F.coalesce("form_company", "owner", "start_date", "form_address").isNotNull()
    unread = form & ~c("used_ocr") & ~c("contact_sheet") & ~identity
    evidence = c("bank").isNotNull() | c("account").isNotNull() | c("period.end").isNotNull() | c("summary_deposits").isNotNull() | c("opening").isNotNull() | c("ending").isNotNull() | (c("txn_count") > 0)
    f = f.withColumns({
        "doc_type": F.when(form, "application").when((c("first_type") == "bank_statement") | evidence, "bank_statement").otherwise(c("first_type")), "kind": F.when(c("contact_sheet"), "contact_sheet").when(form, "form"),
        "text_trusted": trusted, "text_reason": F.when(c("contact_sheet"), "contact_sheet").otherwise(c("quality.reason")), "needs_ocr": F.when(form, unread).otherwise(~c("used_ocr") & c("needs_text")),
        "company": F.when(form, F.coalesce("any_company", "legal_name", "dba")).otherwise(F.coalesce("legal_name", "dba")), "address": F.when(form, c("form_address")).otherwise(c("holder_address")), "holder_name": F.when(~form, c("legal_name")),
        "company_source": F.when(form & c("form_company").isNotNull(), "form").when(form & c("any_company").isNotNull(), "filename"),
        "revenue": F.when(form, None).when(by_rows, c("true_revenue")).otherwise(F.coalesce("summary_deposits", "true_revenue")),
        "revenue_source": F.when(form, None).when(by_rows | c("summary_deposits").isNull(), "transactions").otherwise("statement_summary"), "total_deposits": F.when(~form, F.coalesce("summary_deposits", "gross_deposits")),
        "review_ratio": F.when(c("txn_count") > 0, c("flagged_count") / c("txn_count")).otherwise(0.0),
    })
    f = verdicts.confidence(f)
    f = f.withColumns({"level": F.when(form, F.when(c("text_trusted"), "medium").otherwise("low")).otherwise(c("level")), "points": F.when(~form, c("points"))})
    marks = [c("needs_ocr"), ~form & c("bank").isNull(), ~form & c("truncated"), is_true(~c("reconciles")), ~c("text_trusted")]
    items = sum((is_true(x).cast("long") for x in marks), F.lit(0).cast("long")) + c("flagged_count") + c("position_review_count")
    f = f.withColumns({"review_count": items, "status": F.when(items > 0, "needs_review").otherwise("complete")})
    return f.select(
        "doc_id", "arrival_no", "filename", "doc_type", "kind", "is_mtd", "status", "company", "company_source", "holder_name", "dba", "owner", "address", "bank", T.mask_account(c("account")).alias("account"), c("period.start").alias("period_start"), c("period.end").alias("period_end"),
        "used_ocr", "needs_ocr", "truncated", "text_trusted", "text_reason", "opening", "ending", "summary_deposits", "summary_withdrawals", "summary_confidence", *LEDGER, "revenue", "revenue_source", "total_deposits", "reconciles",
        "reconcile_reason", "reconcile_difference", "review_ratio", "points", "level", "review_count", "fields_found", "stated_revenue", "dob", "start_date", "app_date", "ein", "ssn_mask", "phones", "emails",
    )


def corrected_rows(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows with their corrections; a corrected row needs no more review."""
    return verdicts.apply_corrections(txns, corrections).withColumn("review_flag", F.coalesce("review_flag", F.lit(False)) & ~F.col("corrected"))


def recomputed(facts: DataFrame, txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """facts with the documents that corrections (doc_id, txn_no, field, value, corrected_no) touch derived anew from their corrected
    rows; all others as they are. Only rows of touched documents are read for it, and a proof by the statement's summary no longer
    stands in for them: rows decide whether a corrected statement reconciles."""
    c = F.col
    touched = corrections.select("doc_id").distinct()
    ledger = analytics.ledger_totals(corrected_rows(txns.join(touched, "doc_id", "left_semi"), corrections))
    old = facts.join(touched, "doc_id", "left_semi").drop(*LEDGER, "reconciles", "reconcile_reason", "reconcile_difference")
    new = old.join(ledger, "doc_id", "left").fillna(0, [x for x in LEDGER if not x.startswith("total_")]).withColumns({x: F.coalesce(x, F.lit(0)) for x in ("total_credits", "total_debits")})
    checked = analytics.reconcile_totals(new.select("doc_id", "opening", "ending", *[F.lit(None).cast("double").alias(f"eq_{x}") for x in ("beginning", "ending", "deposits", "withdrawals", "difference")], F.lit(None).cast("boolean").alias("verified"), F.lit(False).alias("truncated"), "total_credits", "total_debits"))
    new = new.join(checked.select("doc_id", "reconciles", c("reason").alias("reconcile_reason"), c("difference").alias("reconcile_difference")), "doc_id")
    by_rows = c("true_revenue")
    ratio = F.when(c("txn_count") > 0, c("flagged_count") / c("txn_count")).otherwise(0.0)
    new = new.withColumns({"revenue": by_rows, "revenue_source": F.lit("transactions"), "total_deposits": c("gross_deposits"), "review_ratio": ratio})
    return facts.join(touched, "doc_id", "left_anti").unionByName(new.select(*facts.columns))



# -- a store of facts ---------------------------------------------------------------------------


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")


def save_facts(facts: DataFrame, path: str, parts: int = 64) -> None:
    """facts as a table in `parts` folders by document."""
    facts.select("*", part_of(parts)).repartition("part").write.partitionBy("part").parquet(path)


def correct_store(path: str, txns: DataFrame, corrections: DataFrame, parts: int = 64) -> list[int]:
    """Applies corrections to save_facts' table: only folders of touched documents are read and written, and only those documents'
    rows are read. The new rows are written aside first, so a failed job leaves the table as it was. Gives the folders' numbers."""
    spark = txns.sparkSession
    touched = sorted(r["part"] for r in corrections.select(part_of(parts)).distinct().collect())  # `parts` numbers at most
    if touched:
        old = spark.read.parquet(path).where(F.col("part").isin(touched))
        new = kept(recomputed(old.drop("part"), txns, corrections).select("*", part_of(parts)))
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return touched

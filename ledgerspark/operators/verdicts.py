"""Per-document verdicts: application fields, confidence, review items, corrections, scores and diagnoses.

Document facts have one row per document: doc_id, arrival_no, filename, doc_type, is_mtd, status, duplicate_of,
company, period_end, reconciles (three-valued), true_revenue, total_deposits, stated_revenue, points, level, and
what else a function names. Nulls are unknown; they never count as false where the rules tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("Company", "Owner", "Phone", "Email", "Address", "Start date", "EIN", "DOB")


def field_flags() -> list[Column]:
    """Whether each of FIELDS was found; a company known by its file name alone isn't."""
    c = F.col
    return [c("company").isNotNull(), c("owner").isNotNull(), F.size("phones") > 0, F.size("emails") > 0, c("address").isNotNull(), c("start_date").isNotNull(), c("ein").isNotNull(), c("dob").isNotNull()]


def fields_found() -> Column:
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in field_flags()), F.lit(0))


def application_field_checks(fields: DataFrame) -> DataFrame:
    """doc_id, field, found: one row per document and field."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(x, F.lit(False)).alias("found")) for n, x in zip(FIELDS, field_flags(), strict=True)])
    return fields.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.field", "x.found")


def confidence(facts: DataFrame) -> DataFrame:
    """facts: bank, text_trusted, used_ocr, reconciles, review_ratio. Points out of 4, level and reasons in order."""
    c = F.col
    bank, trusted, plain, proven = c("bank").isNotNull(), c("text_trusted"), ~c("used_ocr"), F.coalesce(c("reconciles"), F.lit(False))
    points = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (bank, trusted, plain, proven)), F.lit(0))
    wrong = F.coalesce(~c("reconciles"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~bank, "bank_not_recognized"), F.when(~trusted, "low_text_quality"), F.when(~plain, "required_ocr_fallback"),
        F.when(wrong, "reconciliation_mismatch").when(c("reconciles").isNull(), "reconciliation_not_possible"), F.when(c("review_ratio") > 0.35, "high_unparsed_line_ratio"),
    ))
    level = F.when(wrong, "needs_review").when((points == 4) & (c("review_ratio") <= 0.1), "high").when(points >= 2, "medium").otherwise("low")
    return facts.withColumns({"points": points.cast("long"), "level": level, "reasons": reasons})


def field_confidence(source: Column) -> Column:
    return F.when(source.isNull() | (source == ""), "missing").when(source.startswith("document_text"), "high").when(source.startswith("filename"), "low").otherwise("medium")


def review_items(facts: DataFrame, txns: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, type, detail: one row per thing to look at, from facts, uncertain rows and unproven advances."""
    checks = [("needs_ocr", F.col("needs_ocr")), ("unknown_bank", F.col("bank").isNull()), ("statement_truncated", F.col("truncated")), ("reconciliation_mismatch", ~F.col("reconciles")), ("low_text_quality", ~F.col("text_trusted"))]
    items = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in checks]))
    a = facts.select("doc_id", F.explode(items).alias("type"), F.lit(None).cast("string").alias("detail"))
    uncertain = F.col("amount").isNull() | (F.col("direction") == "needs_review")
    b = txns.where(uncertain).select("doc_id", F.lit("transaction_review").alias("type"), F.col("txn_no").cast("string").alias("detail"))
    c = positions.where("status = 'needs_review'").select("doc_id", F.lit("advance_review").alias("type"), F.col("funder").alias("detail"))
    return a.unionByName(b).unionByName(c)


def reviewable_items(facts: DataFrame, txns: DataFrame, positions: DataFrame) -> DataFrame:
    """The same derived anew: rows with the reason direction_unclear or amount_unparsed, mismatch, unknown bank, unproven advances."""
    reason = F.when(F.col("amount").isNull(), "amount_unparsed").when(F.col("direction") == "needs_review", "direction_unclear")
    rows = txns.select("doc_id", reason.alias("reason"), F.col("txn_no").cast("string").alias("detail")).where("reason is not null")
    marks = F.array_compact(F.array(F.when(~F.col("reconciles"), F.lit("reconciliation_mismatch")), F.when(F.col("bank").isNull(), F.lit("unknown_bank"))))
    docs = facts.select("doc_id", F.explode(marks).alias("reason"), F.lit(None).cast("string").alias("detail"))
    return rows.unionByName(docs).unionByName(positions.where("status = 'needs_review'").select("doc_id", F.lit("advance_unproven").alias("reason"), F.col("funder").alias("detail")))


def apply_corrections(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: doc_id, txn_no, field (amount or direction), value, corrected_no (order). The last for each row and field
    wins; the original stays beside the new value, and a corrected row needs no more review. Recompute from these rows alone."""
    keys = ["doc_id", "txn_no"]
    g = corrections.groupBy(*keys).agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("corrected_no"))).alias(f"new_{f}") for f in ("amount", "direction")])
    t = txns.join(g, keys, "left")
    changed = F.col("new_amount").isNotNull() | F.col("new_direction").isNotNull()
    return t.withColumns({
        "original_amount": F.when(F.col("new_amount").isNotNull(), F.col("amount")), "original_direction": F.when(F.col("new_direction").isNotNull(), F.col("direction")),
        "amount": F.coalesce(F.col("new_amount").try_cast("decimal(18,2)"), F.col("amount")), "direction": F.coalesce("new_direction", "direction"), "corrected": changed,
    }).drop("new_amount", "new_direction")


def extraction_score() -> Column:
    """0 to 100: an application by its eight fields, a statement by points, else by level."""
    level = F.col("level")
    by_level = F.when(level == "high", 100).when(level == "medium", 75).when(level == "low", 50).when(level == "needs_review", 35).otherwise(0)
    return F.when(F.col("doc_type") == "application", F.floor(F.coalesce("fields_found", F.lit(0)) * 100 / 8 + 0.5)).when(F.col("points").isNotNull(), F.floor(F.col("points") * 100 / 4 + 0.5)).otherwise(by_level).cast("long")


def revenue_verification() -> Column:
    return F.when(F.col("reconciles"), "verified").when(~F.col("reconciles"), "conflicting").otherwise("unverified")


def document_revenue() -> Column:
    bank = F.when(F.col("true_revenue") > 0, F.col("true_revenue")).otherwise(F.col("total_deposits"))
    return F.coalesce("stated_revenue", bank, F.lit(0)).cast("double")


def final_type_and_status(facts: DataFrame) -> DataFrame:
    """Evidence makes a bank statement of an unknown document; any review item asks for review."""
    evidence = F.coalesce(F.col("txn_count") > 0, F.lit(False)) | F.coalesce("reconciles", F.lit(False))
    kind = F.when((F.col("doc_type") == "unknown") & evidence, "bank_statement").otherwise(F.col("doc_type"))
    return facts.withColumns({"doc_type": kind, "status": F.when(F.col("review_count") > 0, "needs_review").otherwise("complete")})


def diagnose_documents(facts: DataFrame) -> DataFrame:
    """verdict and gaps of each document: pending, duplicate, skipped, failed and stopped first, then by type."""
    c = F.col
    statement = F.array_compact(F.array(F.when(c("reconciles").isNull(), F.lit("balances not proven")), F.when(~c("reconciles"), F.lit("balances do not add up")), F.when(c("bank").isNull(), F.lit("bank unknown")), F.when(c("period_end").isNull(), F.lit("no period"))))
    found = F.coalesce("fields_found", F.lit(0))
    form = F.array_compact(F.array(F.when(found < 8, F.concat(F.lit(8) - found, F.lit(" fields missing")))))
    kind = (
        F.when(c("status").isin("queued", "validating", "extracting", "ocr"), "pending").when(c("duplicate_of").isNotNull(), "duplicate").when(c("status") == "skipped", "excluded")
        .when(c("status") == "failed", "bad").when(c("status") == "stopped", "stopped")
        .when(c("doc_type") == "application", F.when(found >= 6, "good").when(found >= 3, "partial").otherwise("bad"))
        .when(c("doc_type") == "bank_statement", F.when(F.size(statement) == 0, "good").when(F.size(statement) <= 2, "partial").otherwise("bad")).otherwise("bad")
    )
    gaps = F.when(c("doc_type") == "application", form).when(c("doc_type") == "bank_statement", statement).otherwise(F.array(F.lit("not recognised")))
    return facts.select("doc_id", kind.alias("verdict"), F.array_join(gaps, "; ").alias("gaps"))


def bank_accounts(facts: DataFrame) -> DataFrame:
    """Distinct bank and account entries of each lead, in the order of its statements (newest first)."""
    b = facts.where((F.col("doc_type") == "bank_statement") & F.col("bank").isNotNull())
    g = b.groupBy("lead_id", "bank", "account").agg(F.max(F.struct(F.coalesce("period_end", F.lit("")), -F.col("arrival_no"))).alias("newest"))
    entry = F.concat_ws(" • ", "bank", "account")
    order = Window.partitionBy("lead_id").orderBy(F.desc("newest"))
    return g.select("lead_id", entry.alias("entry"), F.row_number().over(order).cast("long").alias("place"))

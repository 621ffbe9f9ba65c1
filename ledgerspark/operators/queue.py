"""The table of documents to read: which of them are put back, which come next, which need OCR, and what came out of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import leads as G
from .leads import _optional, plain_number

# Statuses, names and sentences as they are shown.
RESUMABLE = ("queued", "stopped")
PENDING = ("queued", "validating", "extracting", "ocr")
APPLICATION_NAME = "(?i)application|use_this_app"
DUPLICATE = "Duplicate of an already-scanned file — excluded from company totals"
SKIPPED = "Skipped by the revenue exclusion threshold"
FAILED = "Processing failed"
STOPPED = "Stopped before it finished — restart to read it"
SCANNED = "Scanned image — no usable text layer, nothing read yet. Needs OCR"
LABELS_ONLY = "Form labels only — the answers are not in this PDF's text (typed onto the page image, or printed apart from their labels). Needs OCR"
CONTACTS_ONLY = "; no application form in this file, so no owner, start date or address"
FILENAME_ONLY = "; company name not on the form, only in the filename"
NO_TOTALS = "No balances or deposit total found — nothing to total"
ALL_FOUND = "Bank, period, balances and deposits found; balances add up"
NOT_CHECKED = "balances could not be checked against each other -- revenue not proven"
BY_OCR = " (read by OCR)"
NO_APPLICATION = " · no application for this company"
NO_STATEMENTS = " · no statements matched to it"


def requeue(statuses: DataFrame, which: str) -> DataFrame:
    """All rows; those whose status is `which` (stopped: restart, failed: retry) are queued again, with no attempts and no error."""
    back = F.coalesce(F.col("status") == which, F.lit(False))
    cleared = {c: F.when(~back, F.col(c)) for c in ("error", "error_message") if c in statuses.columns}
    return statuses.withColumns({**cleared, "attempts": F.when(back, 0).otherwise(F.col("attempts")), "status": F.when(back, "queued").otherwise(F.col("status"))})


def scan_order(statuses: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """doc_id, position (from 0) of the documents that wait: files named like applications first, then by arrival_no.

    claimed: doc_id of documents that are taken already but whose status isn't written yet."""
    d = statuses.where(F.col("status").isin(*RESUMABLE))
    d = d.join(claimed.select("doc_id").distinct(), "doc_id", "left_anti") if claimed is not None else d
    named = F.coalesce(F.element_at(F.split("filename", "/"), -1).rlike(APPLICATION_NAME), F.lit(False))
    d = d.select("doc_id", "arrival_no", F.when(named, 0).otherwise(1).alias("rank"))
    return G.numbered_by(d, "rank", "arrival_no", "doc_id").select("doc_id", F.col("position").cast("long").alias("position"))


def needs_ocr_now(facts: DataFrame) -> Column:
    """needs_ocr, but an application decides for itself: it needs OCR if none of its company, owner, start date and address was
    read (they all are in `missing`), it isn't a contact sheet and wasn't read by OCR."""
    unread = F.size(F.array_intersect("missing", F.array(*map(F.lit, ("Company", "Owner", "Start date", "Address"))))) == 4
    sheet = F.coalesce(_optional(facts, "kind") == "contact_sheet", F.lit(False))
    own = F.coalesce(unread, F.lit(False)) & ~sheet & ~F.coalesce("used_ocr", F.lit(False))
    return F.when(F.col("doc_type") == "application", own).otherwise(F.coalesce("needs_ocr", F.lit(False)))


def ocr_candidates(facts: DataFrame) -> DataFrame:
    """The rows that need OCR and weren't read by it."""
    return facts.where(needs_ocr_now(facts) & ~F.coalesce("used_ocr", F.lit(False)))


def truncated(facts: DataFrame) -> Column:
    """Whether fewer pages were read than there are; both numbers have to be known and not zero."""
    read, all_pages = F.col("scanned_page_count"), F.col("page_count")
    return F.coalesce((read > 0) & (all_pages > 0) & (read < all_pages), F.lit(False))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _application(facts: DataFrame, ocr: Column, note: Column) -> tuple[Column, Column]:
    phones, emails = (F.coalesce(F.col(c), F.lit(0)) for c in ("phone_count", "email_count"))
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    found = F.lit(8) - F.size(missing)

    def some(n: Column, one: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))

    sheet = F.coalesce(_optional(facts, "kind") == "contact_sheet", F.lit(False))
    by_name = F.when(F.coalesce(_optional(facts, "company_source") == "filename", F.lit(False)), FILENAME_ONLY).otherwise("")
    so_far = F.when((phones > 0) | (emails > 0), F.concat(F.lit("; "), phones.cast("string"), F.lit(" phone(s), "), emails.cast("string"), F.lit(" email(s) found so far"))).otherwise("")
    verdict = F.when(sheet, "partial").when(ocr, "bad").when(found >= 6, "good").when(found >= 3, "partial").otherwise("bad")
    told = (
        F.when(sheet, F.concat(F.lit("Contact list only — "), some(phones, "phone"), F.lit(", "), some(emails, "email"), F.lit(CONTACTS_ONLY)))
        .when(ocr, F.concat(F.lit(LABELS_ONLY), so_far)).when(found == 8, F.concat(F.lit("All 8 application fields found"), note))
        .otherwise(F.concat(F.lit("Found "), found.cast("string"), F.lit(" of 8 — missing "), F.array_join(missing, ", "), by_name, note))
    )
    return verdict, told


def _statement(facts: DataFrame, ocr: Column, note: Column) -> tuple[Column, Column]:
    c = F.col
    opening, ending, deposits = (c(x).isNotNull() & ~F.isnan(c(x).cast("double")) for x in ("opening", "ending", "deposits"))
    nothing = ~opening & ~ending & ~deposits
    pages = F.concat(c("scanned_page_count").cast("string"), F.lit(" of "), c("page_count").cast("string"), F.lit(" pages"))
    limit = F.when(F.coalesce("used_ocr", F.lit(False)) & truncated(facts), F.concat(F.lit(" — OCR read "), pages, F.lit("; raise the OCR page limit and re-run"))).otherwise("")
    gap = F.concat(F.lit("balances do not add up (Δ "), F.coalesce(plain_number(c("difference")), F.lit("?")), F.lit(") -- revenue not proven"))
    gaps = F.array_compact(F.array(
        F.when(_blank("bank"), "bank not recognised"), F.when(_blank("period_end"), "no statement period"), F.when(_blank("account"), "no account number"),
        F.when(~opening & ~ending, "no opening/ending balance").when(~opening, "no opening balance").when(~ending, "no ending balance"), F.when(~deposits, "no deposit total"),
        F.when(F.coalesce(_optional(facts, "holder_name"), _optional(facts, "company_guess")).isNull(), "no account-holder name"), F.when(truncated(facts), F.concat(F.lit("read "), pages)),
        F.when(~c("reconciles"), gap).when(c("reconciles").isNull(), NOT_CHECKED),
    ))
    verdict = F.when(ocr | nothing, "bad").when(F.size(gaps) == 0, "good").otherwise("partial")
    told = F.when(ocr, SCANNED).when(nothing, F.concat(F.lit(NO_TOTALS), limit, note)).when(F.size(gaps) == 0, F.concat(F.lit(ALL_FOUND), note)).otherwise(F.concat(F.lit("Read, but "), F.array_join(gaps, ", "), note))
    return verdict, told


def diagnoses(facts: DataFrame, leads: DataFrame) -> DataFrame:
    """doc_id, verdict (good, partial, bad, pending, excluded), summary and company of each document.

    facts: a row a document, with its lead_id (null: none), status, error_message, what was read and `missing`, the names of an
    application's fields that weren't. leads: lead_id, company_name, has_application, statement_count, a row a lead; a document
    that gave something is told what its lead lacks."""
    c = F.col
    used = F.coalesce("used_ocr", F.lit(False))
    ocr, note = F.coalesce("needs_ocr", F.lit(False)) & ~used, F.when(used, BY_OCR).otherwise("")
    unknown = F.when(ocr, SCANNED).otherwise(F.concat(F.lit("Not recognised as a bank statement or an application ("), F.coalesce(_optional(facts, "text_chars", "long"), F.lit(0)).cast("string"), F.lit(" characters of text)")))
    app, stmt = c("doc_type") == "application", c("doc_type") == "bank_statement"
    (app_verdict, app_told), (stmt_verdict, stmt_told) = _application(facts, ocr, note), _statement(facts, ocr, note)
    own = F.nullif(c("error_message"), F.lit(""))

    def said(verdict: Column | str, told: Column | str) -> Column:
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(name) for name, x in (("v", verdict), ("s", told))])

    early = (
        F.when(c("status").isin(*PENDING), said("pending", "")).when(c("duplicate_of").isNotNull(), said("excluded", DUPLICATE)).when(c("status") == "skipped", said("excluded", F.coalesce(own, F.lit(SKIPPED))))
        .when(c("status") == "failed", said("bad", F.coalesce(own, F.lit(FAILED)))).when(c("status") == "stopped", said("pending", STOPPED))
    )
    read = F.when(app, said(app_verdict, app_told)).when(stmt, said(stmt_verdict, stmt_told)).otherwise(said("bad", unknown))
    d = facts.select("doc_id", "lead_id", "doc_type", early.alias("early"), read.alias("read"))
    d = d.join(leads.select("lead_id", "company_name", "has_application", "statement_count"), "lead_id", "left")
    lacks = F.when((c("doc_type") == "bank_statement") & ~c("has_application"), NO_APPLICATION).when((c("doc_type") == "application") & (c("statement_count") == 0), NO_STATEMENTS)
    summary = F.when(c("early").isNotNull(), c("early.s")).when(c("read.v") != "bad", F.concat("read.s", F.coalesce(lacks, F.lit("")))).otherwise(c("read.s"))
    return d.select("doc_id", F.coalesce("early.v", "read.v").alias("verdict"), summary.alias("summary"), c("company_name").alias("company"))


def run_report(facts: DataFrame) -> DataFrame:
    """A row a status: documents, truncated ones, time-outs, those tried more than once, read by OCR and flagged for it."""
    counts = {"truncated": truncated(facts), "timeouts": F.col("error") == "job_timeout", "retried": F.col("attempts") > 1, "ocr_used": F.col("used_ocr"), "ocr_flagged": F.col("needs_ocr")}
    return facts.groupBy("status").agg(F.count("*").cast("long").alias("documents"), *[F.count(F.when(x, 1)).cast("long").alias(name) for name, x in counts.items()])

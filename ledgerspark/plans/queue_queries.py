"""Queries over the table of documents to read, derived from customer, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leads as G
from ..operators import queue as Q
from ..operators.verdicts import FIELDS
from ..sources import bridge as B
from .lead_queries import LEADS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What the queue and the diagnoses read beside the facts: column, Spark SQL and DuckDB SQL alike.
MORE = {
    "attempts": "doc_id % 3",
    "error": "CASE WHEN status = 'failed' THEN 'job_timeout' END",
    "error_message": "CASE WHEN status IN ('failed', 'skipped') AND doc_id % 2 = 0 THEN 'Text of ' || doc_id END",
    "needs_ocr": "doc_id % 7 = 3",
    "phone_count": "doc_id % 4",
    "email_count": "doc_id % 3",
    "opening": "CASE WHEN doc_id % 4 <> 2 THEN CAST(doc_id AS DOUBLE) END",
    "ending": "CASE WHEN doc_id % 3 <> 1 THEN CAST(doc_id AS DOUBLE) END",
    "deposits": "CASE WHEN doc_id % 5 <> 2 THEN CAST(doc_id AS DOUBLE) END",
    "holder_name": "CASE WHEN doc_id % 6 <> 4 THEN company END",
    "company_source": "CASE WHEN doc_id % 4 = 1 THEN 'filename' ELSE 'form' END",
    "page_count": "doc_id % 6",
    "scanned_page_count": "doc_id % 5",
    "difference": "CASE WHEN doc_id % 3 = 1 AND doc_id % 4 <> 1 THEN doc_id % 7 + 0.5 END",
    "text_chars": "doc_id * 3",
}
_MISSING = ", ".join(f"CASE WHEN CAST(floor(doc_id / 7) AS BIGINT) % {i % 3 + 2} = 0 THEN '{x}' END" for i, x in enumerate(FIELDS))
MORE_SQL = f"""{B.FACTS_SQL}, more AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in MORE.items())}, list_filter([{_MISSING}], lambda x: x IS NOT NULL) AS missing FROM facts)"""
OCR_NOW = "CASE WHEN doc_type = 'application' THEN list_has_all(missing, ['Company', 'Owner', 'Start date', 'Address']) AND coalesce(kind, '') <> 'contact_sheet' AND NOT used_ocr ELSE needs_ocr END"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {MORE_SQL} {sql}"
        return f

    return add


def _more(d: DataFrame) -> DataFrame:
    return d.select("*", *[F.expr(x).alias(name) for name, x in MORE.items()], F.expr(f"array_compact(array({_MISSING}))").alias("missing"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _more(B.facts(spark, sf_dir))


def _again(status: str) -> str:
    kept = f"status IS DISTINCT FROM '{status}'"
    return f"SELECT doc_id, CASE WHEN {kept} THEN status ELSE 'queued' END AS status, CASE WHEN {kept} THEN attempts ELSE 0 END AS attempts, CASE WHEN {kept} THEN error END AS error, CASE WHEN {kept} THEN error_message END AS error_message FROM more"


@query(_again("stopped"))
def restart_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.requeue(_facts(spark, sf_dir), "stopped").select("doc_id", "status", F.col("attempts").cast("long").alias("attempts"), "error", "error_message")


@query(_again("failed"))
def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.requeue(_facts(spark, sf_dir), "failed").select("doc_id", "status", F.col("attempts").cast("long").alias("attempts"), "error", "error_message")


NAMED = "CASE WHEN doc_type = 'application' AND doc_id % 3 <> 2 THEN replace(filename, '.pdf', ' Application.pdf') ELSE 'Applications/' || filename END"


@query(f"""SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_type = 'application' AND doc_id % 3 <> 2 THEN 0 ELSE 1 END, arrival_no) - 1 AS position FROM more
 WHERE status IN ('queued', 'stopped') AND doc_id NOT IN (SELECT s_suppkey FROM supplier)""")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    return Q.scan_order(_facts(spark, sf_dir).withColumn("filename", F.expr(NAMED)), claimed)


@query(f"SELECT doc_id, doc_type FROM more WHERE {OCR_NOW} AND NOT used_ocr")
def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ocr_candidates(_facts(spark, sf_dir)).select("doc_id", "doc_type")


CUT = "(scanned_page_count > 0 AND page_count > 0 AND scanned_page_count < page_count)"
_PAGES = "scanned_page_count || ' of ' || page_count || ' pages'"
_GAPS = f"""list_filter([CASE WHEN bank IS NULL THEN 'bank not recognised' END, CASE WHEN period_end IS NULL THEN 'no statement period' END, CASE WHEN account IS NULL THEN 'no account number' END,
 CASE WHEN opening IS NULL AND ending IS NULL THEN 'no opening/ending balance' WHEN opening IS NULL THEN 'no opening balance' WHEN ending IS NULL THEN 'no ending balance' END, CASE WHEN deposits IS NULL THEN 'no deposit total' END,
 CASE WHEN holder_name IS NULL THEN 'no account-holder name' END, CASE WHEN {CUT} THEN 'read ' || {_PAGES} END,
 CASE WHEN reconciles = false THEN 'balances do not add up (Δ ' || coalesce(CAST(doc_id % 7 AS VARCHAR) || CASE WHEN difference IS NOT NULL THEN '.5' END, '?') || ') -- revenue not proven' WHEN reconciles IS NULL THEN '{Q.NOT_CHECKED}' END], lambda x: x IS NOT NULL)"""


@query(f""", {LEADS.replace('FROM facts)', 'FROM more)', 1)},
told AS (SELECT m.*, has_application, statement_count, company_name, {_GAPS} AS gaps, 8 - len(missing) AS found, m.needs_ocr AND NOT used_ocr AS ocr, opening IS NULL AND ending IS NULL AND deposits IS NULL AS nothing, CASE WHEN used_ocr THEN '{Q.BY_OCR}' ELSE '' END AS note FROM merged m JOIN leads USING (lead_id)),
judged AS (SELECT *, CASE WHEN status IN ('queued', 'validating', 'extracting', 'ocr') THEN 'pending' WHEN duplicate_of IS NOT NULL OR status = 'skipped' THEN 'excluded' WHEN status = 'failed' THEN 'bad' WHEN status = 'stopped' THEN 'pending' END AS early,
 CASE doc_type WHEN 'application' THEN CASE WHEN kind = 'contact_sheet' THEN 'partial' WHEN ocr THEN 'bad' WHEN found >= 6 THEN 'good' WHEN found >= 3 THEN 'partial' ELSE 'bad' END WHEN 'bank_statement' THEN CASE WHEN ocr OR nothing THEN 'bad' WHEN len(gaps) = 0 THEN 'good' ELSE 'partial' END ELSE 'bad' END AS later,
 CASE doc_type WHEN 'application' THEN CASE WHEN kind = 'contact_sheet' THEN 'Contact list only — ' || phone_count || ' phone' || CASE WHEN phone_count = 1 THEN '' ELSE 's' END || ', ' || email_count || ' email' || CASE WHEN email_count = 1 THEN '' ELSE 's' END || '{Q.CONTACTS_ONLY}'
   WHEN ocr THEN '{Q.LABELS_ONLY.replace("'", "''")}' || CASE WHEN phone_count > 0 OR email_count > 0 THEN '; ' || phone_count || ' phone(s), ' || email_count || ' email(s) found so far' ELSE '' END
   WHEN found = 8 THEN 'All 8 application fields found' || note ELSE 'Found ' || found || ' of 8 — missing ' || array_to_string(missing, ', ') || CASE WHEN company_source = 'filename' THEN '{Q.FILENAME_ONLY}' ELSE '' END || note END
  WHEN 'bank_statement' THEN CASE WHEN ocr THEN '{Q.SCANNED}' WHEN nothing THEN '{Q.NO_TOTALS}' || CASE WHEN used_ocr AND {CUT} THEN ' — OCR read ' || {_PAGES} || '; raise the OCR page limit and re-run' ELSE '' END || note WHEN len(gaps) = 0 THEN '{Q.ALL_FOUND}' || note ELSE 'Read, but ' || array_to_string(gaps, ', ') || note END
  ELSE CASE WHEN ocr THEN '{Q.SCANNED}' ELSE 'Not recognised as a bank statement or an application (' || text_chars || ' characters of text)' END END AS words FROM told)
SELECT doc_id, coalesce(early, later) AS verdict, company_name AS company, CASE WHEN status IN ('queued', 'validating', 'extracting', 'ocr') THEN '' WHEN duplicate_of IS NOT NULL THEN '{Q.DUPLICATE}' WHEN status = 'skipped' THEN coalesce(error_message, '{Q.SKIPPED}')
 WHEN status = 'failed' THEN coalesce(error_message, '{Q.FAILED}') WHEN status = 'stopped' THEN '{Q.STOPPED}' WHEN later <> 'bad' AND doc_type = 'bank_statement' AND NOT has_application THEN words || '{Q.NO_APPLICATION}' WHEN later <> 'bad' AND doc_type = 'application' AND statement_count = 0 THEN words || '{Q.NO_STATEMENTS}' ELSE words END AS summary FROM judged""")
def document_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir)))
    return Q.diagnoses(_more(keyed), G.lead_facts(keyed))


@query(f"""SELECT status, count(*) AS documents, count(*) FILTER ({CUT}) AS truncated, count(*) FILTER (error = 'job_timeout') AS timeouts, count(*) FILTER (attempts > 1) AS retried, count(*) FILTER (used_ocr) AS ocr_used, count(*) FILTER (needs_ocr) AS ocr_flagged FROM more GROUP BY 1""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.run_report(_facts(spark, sf_dir))

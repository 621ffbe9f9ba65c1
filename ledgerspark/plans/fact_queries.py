"""Document facts of statements rendered from the ledger, before and after corrections, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, statements
from ..sources import bridge as B
from ..sources import store
from .balance_queries import SUMMARY, SUMMARY_ROWS, TEXTS
from .ledger_queries import EVENTS, FUNDER, KIND

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
q = B.sql_text

# Heads of statements; {u} is the account's number, {u4} and {u6} the same with leading zeros.
HEADS = [
    "Chase Business Banking\nAccount Holder: Acme {u} Traders LLC\n{u} Main St\nAustin, TX 78753\nAccount Number: 7700{u6}\nStatement Period 01/01/2024 - 01/31/2024",
    "PNC Bank\nBLUE {u} FOODS INC\n12 Oak Ave Ste {u}\nReno, NV 89501\nAccount # XXXX{u4}\nmonth to date",
    "letter from the desk",
    "Wells Fargo Everyday\nDoing Business As: Corner {u}\nStatement ending 02/29/2024",
]
BLOCKS = ["Beginning balance $1,000.00\nTotal deposits {in}\nTotal withdrawals {out}\nEnding balance {end}"] * 2 + ["Beginning balance $1,000.00\nTotal deposits {in}\nTotal withdrawals {out}\nEnding balance {off}", ""]
# What the rules read from each head.
READ = {
    "bank": ["'Chase'", "'PNC Bank'", "NULL", "'Wells Fargo'"], "account": ["'XXXX' || right(lpad(CAST(doc_id AS VARCHAR), 6, '0'), 4)", "'XXXX' || lpad(CAST(doc_id AS VARCHAR), 4, '0')", "NULL", "NULL"],
    "company": ["'Acme ' || doc_id || ' Traders LLC'", "'BLUE ' || doc_id || ' FOODS INC'", "NULL", "'Corner ' || doc_id"], "address": ["doc_id || ' Main St, Austin, TX 78753'", "'12 Oak Ave Ste ' || doc_id || ', Reno, NV 89501'", "NULL", "NULL"],
    "period_start": ["'2024-01-01'", "NULL", "NULL", "NULL"], "period_end": ["'2024-01-31'", "NULL", "NULL", "'2024-02-29'"],
}


def _dollars(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x).cast("decimal(18,2)"), 2))


def statement_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per account: a head, a summary with the ledger's totals (every fourth a dollar off, every fourth none) and its rows."""
    t = B.ledger(spark, sf_dir)
    g = t.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("direction") == k, F.col("amount"))), F.lit(0)).alias(k) for k in ("credit", "debit")])
    end = F.lit(1000) + F.col("credit") - F.col("debit")
    u = F.col("doc_id").cast("string")
    text = F.concat_ws("\n", B.pick(HEADS, F.col("doc_id")), B.pick(BLOCKS, F.col("doc_id")), "raw_text")
    for name, value in {"u": u, "u4": F.lpad(u, 4, "0"), "u6": F.lpad(u, 6, "0"), "in": _dollars(F.col("credit")), "out": _dollars(F.col("debit")), "end": _dollars(end), "off": _dollars(end + 1)}.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    d = g.join(statements.render_statements(t), "doc_id")
    n = F.col("doc_id")
    return d.select("doc_id", n.alias("arrival_no"), F.lit("statement.pdf").alias("filename"), text.alias("raw_text"), (n % 3 == 0).alias("used_ocr"), F.lit(3).alias("page_count"), F.when(n % 8 == 3, 1).otherwise(3).alias("pages_read"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements' texts with what columns tell of them, in buckets of the document."""
    return store.bucketed(facts.told_by_text(statement_docs(spark, sf_dir), 2026), "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _by_layout(name: str) -> str:
    return "CASE CAST(doc_id % 4 AS BIGINT) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(READ[name])) + f" END AS {name}"


def _pick_layout(values: list[str]) -> str:
    return f"[{', '.join(q(x) for x in values)}][CAST(g.doc_id % 4 AS BIGINT) + 1]".replace("\n", "' || chr(10) || '")


def _usd(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', CAST(abs({x}) AS DOUBLE))"


def _filled(text: str) -> str:
    u = "CAST(g.doc_id AS VARCHAR)"
    values = {"u": u, "u4": f"lpad({u}, 4, '0')", "u6": f"lpad({u}, 6, '0')", "in": _usd("g.c"), "out": _usd("g.d"), "end": _usd("(1000 + g.c - g.d)"), "off": _usd("(1001 + g.c - g.d)")}
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


PARSED = """x AS (SELECT *, CASE direction WHEN 'credit' THEN 0 ELSE 1 END AS part FROM events_ledger WHERE direction IN ('credit', 'debit')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, txn_no) AS no, CASE WHEN part = 1 THEN nullif(regexp_extract(description, '(?i)\\b(?:check|cheque|chk)\\s*#?\\s*(\\d{3,6})\\b', 1), '') END AS check_number FROM x),
ledger AS (SELECT doc_id, no AS txn_no, txn_date, description, amount, direction FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, check_number ORDER BY no) AS again FROM numbered) WHERE check_number IS NULL OR again = 1)"""
ROWS = f"""{B.LEDGER_SQL.replace('ledger AS (', 'events_ledger AS (', 1).replace('FROM ledger)', 'FROM events_ledger)')}, {PARSED},
line AS (SELECT doc_id, txn_no, direction, strftime(txn_date, '%m/%d/%Y') || ' ' || description || ' ' || CAST(amount AS VARCHAR) AS l FROM events_ledger),
g AS (SELECT doc_id, coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS d FROM events_ledger GROUP BY 1),
body AS (SELECT doc_id, array_to_string(list_concat(['Account Statement', 'Deposits and other credits'], coalesce(list(l ORDER BY txn_no) FILTER (direction = 'credit'), []), ['Total deposits', 'Withdrawals and other debits'], coalesce(list(l ORDER BY txn_no) FILTER (direction = 'debit'), []), ['Total withdrawals']), chr(10)) AS rows_text FROM line WHERE direction IN ('credit', 'debit') GROUP BY 1),
docs AS (SELECT g.doc_id, {_filled(_pick_layout(HEADS))} || chr(10) || {_filled(_pick_layout(BLOCKS))} || chr(10) || rows_text AS raw_text, g.doc_id % 3 = 0 AS used_ocr FROM g JOIN body USING (doc_id))"""
STATEMENT_TEXTS = ROWS + TEXTS[TEXTS.index(",\nsplit AS") :]
TOTALS = f"""deposit_kinds AS (SELECT *, {KIND} AS kind, {FUNDER.replace('(d,', '(low,').replace('contains(d,', 'contains(low,')} AS funder FROM (SELECT *, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS low FROM ledger)),
{EVENTS.replace("kinds AS", "event_kinds AS").replace("FROM kinds", "FROM event_kinds")},
event_counts AS (SELECT doc_id, count(*) AS event_count FROM found WHERE p = 1 GROUP BY 1),
payees AS (SELECT doc_id, funder, count(*) AS n FROM deposit_kinds WHERE direction = 'debit' AND funder IS NOT NULL GROUP BY 1, 2),
payee_counts AS (SELECT doc_id, count(*) AS position_count, count(*) FILTER (n < 2 AND funder <> 'DoorDash Capital') AS position_review_count FROM payees GROUP BY 1),
totals AS (SELECT doc_id, count(*) AS txn_count, CAST(coalesce(sum(amount) FILTER (kind IS NOT NULL), 0) AS DOUBLE) AS gross_deposits, CAST(coalesce(sum(amount) FILTER (kind = 'revenue'), 0) AS DOUBLE) AS true_revenue, CAST(coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS DOUBLE) AS total_credits, CAST(coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS DOUBLE) AS total_debits FROM deposit_kinds GROUP BY 1)"""
FACTS = f"""{SUMMARY.replace(TEXTS, STATEMENT_TEXTS)}, summary AS ({SUMMARY_ROWS}), {TOTALS},
counted_chars AS (SELECT doc_id, length(regexp_replace(raw_text, '\\s+', '', 'g')) AS n_text FROM docs),
joined_facts AS (SELECT docs.doc_id, {', '.join(_by_layout(x) for x in READ)}, docs.used_ocr, docs.doc_id % 8 = 3 AS truncated, docs.doc_id % 4 = 1 AS is_mtd, eq.verified AS proven, eq.layout AS eq_layout, summary.beginning AS opening, summary.ending AS ending, summary.deposits AS summary_deposits, summary.withdrawals AS summary_withdrawals, summary.confidence AS summary_confidence,
 coalesce(txn_count, 0) AS txn_count, coalesce(gross_deposits, 0) AS gross_deposits, coalesce(true_revenue, 0) AS true_revenue, coalesce(total_credits, 0) AS total_credits, coalesce(total_debits, 0) AS total_debits, coalesce(event_count, 0) AS event_count, coalesce(position_count, 0) AS position_count, coalesce(position_review_count, 0) AS position_review_count, n_text
 FROM docs LEFT JOIN eq USING (doc_id) LEFT JOIN summary USING (doc_id) LEFT JOIN totals USING (doc_id) LEFT JOIN event_counts USING (doc_id) LEFT JOIN payee_counts USING (doc_id) LEFT JOIN counted_chars USING (doc_id)),
judged AS (SELECT *, CASE WHEN n_text < 200 THEN 'insufficient_text' WHEN coalesce(proven, false) THEN 'statement_arithmetic_proven' ELSE 'ok' END AS text_reason, CASE WHEN proven THEN 'ok' WHEN eq_layout IS NOT NULL THEN 'equation_not_provable' WHEN truncated THEN 'statement_truncated' WHEN opening IS NULL OR ending IS NULL THEN 'missing_opening_or_ending_balance' END AS reconcile_reason, CASE WHEN proven THEN true END AS reconciles,
 CASE WHEN NOT truncated AND true_revenue > 0 THEN true_revenue ELSE coalesce(summary_deposits, true_revenue) END AS revenue, CASE WHEN (NOT truncated AND true_revenue > 0) OR summary_deposits IS NULL THEN 'transactions' ELSE 'statement_summary' END AS revenue_source, coalesce(summary_deposits, gross_deposits) AS total_deposits FROM joined_facts),
pointed AS (SELECT *, CAST((bank IS NOT NULL)::INT + (text_reason <> 'insufficient_text')::INT + (NOT used_ocr)::INT + coalesce(reconciles, false)::INT AS BIGINT) AS points, CAST((bank IS NULL)::INT + truncated::INT + (text_reason = 'insufficient_text')::INT + position_review_count AS BIGINT) AS review_count FROM judged),
statement_facts AS (SELECT *, CASE WHEN points = 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level, CASE WHEN review_count > 0 THEN 'needs_review' ELSE 'complete' END AS status FROM pointed)"""
COLUMNS = [
    "doc_id", "is_mtd", "status", "company", "address", "bank", "account", "period_start", "period_end", "used_ocr", "truncated", "text_reason", "opening", "ending", "summary_deposits", "summary_withdrawals", "summary_confidence", "txn_count",
    "gross_deposits", "true_revenue", "total_credits", "total_debits", "event_count", "position_count", "position_review_count", "revenue", "revenue_source", "total_deposits", "reconciles", "reconcile_reason", "points", "level", "review_count",
]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _shown(d: DataFrame) -> DataFrame:
    return d.select(*[F.col(x).cast("double").alias(x) if x in ("total_credits", "total_debits") else F.col(x) for x in COLUMNS])


@query(f"{FACTS} SELECT {', '.join(COLUMNS)} FROM statement_facts")
def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a statement per account, each column of one row."""
    return _shown(facts.document_facts(_told(spark, sf_dir)))


def _again(sql: str, names: tuple[str, ...]) -> str:
    """Tables of sql under other names, over the corrected ledger."""
    for name in names:
        sql = re.sub(rf"\b{name}\b(?! AS kind)", f"{name}_new", sql)
    return sql


CORRECTED = f"""{FACTS},
ledger_new AS (SELECT doc_id, txn_no, txn_date, description, CASE WHEN doc_id % 5 = 0 AND txn_no % 7 = 0 THEN CAST(7.25 AS DECIMAL(18,2)) ELSE amount END AS amount, CASE WHEN doc_id % 5 = 0 AND txn_no % 4 = 1 THEN 'debit' ELSE direction END AS direction FROM ledger),
{_again(TOTALS, ('ledger', 'deposit_kinds', 'event_kinds', 'found', 'event_counts', 'payees', 'payee_counts', 'totals'))},
touched AS (SELECT DISTINCT doc_id FROM ledger WHERE doc_id % 5 = 0 AND (txn_no % 7 = 0 OR txn_no % 4 = 1)),
redone AS (SELECT f.* EXCLUDE (txn_count, gross_deposits, true_revenue, total_credits, total_debits, event_count, position_count, position_review_count), t.txn_count, t.gross_deposits, t.true_revenue, t.total_credits, t.total_debits, coalesce(e.event_count, 0) AS event_count, coalesce(p.position_count, 0) AS position_count, coalesce(p.position_review_count, 0) AS position_review_count,
 f.opening + t.total_credits - t.total_debits - f.ending AS gap FROM statement_facts f JOIN touched USING (doc_id) JOIN totals_new t USING (doc_id) LEFT JOIN event_counts_new e USING (doc_id) LEFT JOIN payee_counts_new p USING (doc_id)),
judged_again AS (SELECT * REPLACE (true_revenue AS revenue, 'transactions' AS revenue_source, gross_deposits AS total_deposits, CASE WHEN gap IS NULL THEN NULL ELSE abs(gap) <= 0.02 END AS reconciles, CASE WHEN gap IS NULL THEN 'missing_opening_or_ending_balance' WHEN abs(gap) <= 0.02 THEN 'ok' ELSE 'mismatch' END AS reconcile_reason) FROM redone)"""


@query(f"{CORRECTED} SELECT {', '.join(COLUMNS)} FROM judged_again UNION ALL SELECT {', '.join(COLUMNS)} FROM statement_facts WHERE doc_id NOT IN (SELECT doc_id FROM touched)")
def recompute_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts after corrections to every fifth account: each fourth row becomes a debit, each seventh amount 7.25."""
    told = _told(spark, sf_dir)
    t = store.kept(statements.parse_transactions(told.where("doc_id % 5 = 0").select("doc_id", "raw_text", "statement_year")))
    turned = t.where("txn_no % 4 = 1").select("doc_id", "txn_no", F.lit("direction").alias("field"), F.lit("debit").alias("value"), F.lit(1).alias("corrected_no"))
    priced = t.where("txn_no % 7 = 0").select("doc_id", "txn_no", F.lit("amount").alias("field"), F.lit("7.25").alias("value"), F.lit(1).alias("corrected_no"))
    return _shown(facts.recomputed(store.kept(facts.document_facts(told)), t, turned.unionByName(priced)))

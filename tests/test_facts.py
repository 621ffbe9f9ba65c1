"""Document facts: statements, forms, letters and nulls in one job; exchanges; corrections against a full recompute."""

from __future__ import annotations

import os

import pytest

from ledgerspark.operators import analytics, facts, statements
from ledgerspark.sources import store

STATEMENT = """Chase Business Banking
Account Holder: Acme Tools LLC
12 Main St
Austin, TX 78753
Account Number: 770012345678
Statement Period 01/01/2026 - 01/31/2026
Beginning balance $1,000.00
Total deposits $150.00
Total withdrawals $30.00
Ending balance {end}
Account Statement of the business, with the transaction description of every row that was posted in the period
Deposits and other credits
01/05/2026 CUSTOMER DEPOSIT 100.00
01/07/2026 ONLINE TRANSFER FROM SAVINGS 50.00
Total deposits
Withdrawals and other debits
01/08/2026 KAPITUS DAILY PMT 10.00
01/09/2026 NSF FEE 20.00
Total withdrawals"""
FORM = """Legal Business Name: Blue River Foods Inc
Owner Name: Ann Lee
Date of Birth: 02/03/1975
Business Start Date: 2011-01-05
Use of funds: stock of goods for the season to come, with the loan amount as stated in the letter beside this form
Average Monthly Revenue: $125,000
Cell (212) 555-0101 ann@blueriver.com and further lines of this form that carry no answers whatever they may say here"""
DOCS = [
    (1, STATEMENT.format(end="$1,120.00"), "a/s1.pdf", False, 2, 2),
    (2, STATEMENT.format(end="$1,121.00"), "s2.pdf", True, 3, 1),
    (3, FORM, "forms/APP.pdf", False, 1, 1),
    (4, "Mobile\n(212) 555-0199\nEmail\nsam@shop.org\n(312) 555-0142", "contacts.pdf", False, 1, 1),
    (5, "Legal company name:\nUse of funds:\nDate of birth:", "Zed-Co.pdf", False, None, None),
    (6, "A letter without anything", "letter.pdf", False, 1, 1),
    (7, None, None, None, None, None),
    (8, "01/05/2026 CUSTOMER DEPOSIT 100.00\n01/06/2026 SOMETHING 5.00", "x.pdf", False, 1, 1),
]


def docs_of(spark):
    return spark.createDataFrame([(i, i, f, t, o, n, r) for i, t, f, o, n, r in DOCS], "doc_id long, arrival_no long, filename string, raw_text string, used_ocr boolean, page_count int, pages_read int")


@pytest.fixture(scope="module")
def table(spark):
    return store.bucketed(facts.told_by_text(docs_of(spark), 2026), "doc_id", 4)


@pytest.fixture(scope="module")
def found(table):
    return store.kept(facts.document_facts(table))


@pytest.fixture(scope="module")
def rows(found):
    return {r["doc_id"]: r for r in found.collect()}


def test_statement(rows):
    r = rows[1]
    want = {
        "doc_type": "bank_statement", "bank": "Chase", "account": "XXXX5678", "company": "Acme Tools LLC", "address": "12 Main St, Austin, TX 78753", "period_end": "2026-01-31", "opening": 1000.0, "ending": 1120.0, "summary_confidence": 99,
        "txn_count": 4, "gross_deposits": 150.0, "true_revenue": 100.0, "event_count": 1, "position_count": 1, "position_review_count": 1, "revenue": 100.0, "revenue_source": "transactions", "total_deposits": 150.0, "reconciles": True, "points": 4, "level": "high",
        "review_count": 1, "status": "needs_review", "truncated": False, "text_reason": "statement_arithmetic_proven",
    }
    assert {k: r[k] for k in want} == want
    off = rows[2]
    assert (off["reconciles"], off["reconcile_reason"], off["truncated"], off["revenue"], off["revenue_source"], off["summary_confidence"]) == (None, "equation_not_provable", True, 150.0, "statement_summary", 40)


def test_forms_and_others(rows):
    r = rows[3]
    assert (r["doc_type"], r["kind"], r["company"], r["owner"], r["dob"], r["start_date"], r["stated_revenue"], r["level"], r["status"], r["points"]) == ("application", "form", "Blue River Foods Inc", "Ann Lee", "02/03/75", "01/05/2011", 125000.0, "medium", "complete", None)
    assert (rows[4]["kind"], rows[4]["text_reason"], rows[4]["phones"], rows[4]["status"]) == ("contact_sheet", "contact_sheet", ["(212) 555-0199", "(312) 555-0142"], "complete")
    assert (rows[5]["doc_type"], rows[5]["needs_ocr"], rows[5]["company"], rows[5]["level"]) == ("application", True, "Zed Co", "low")
    assert (rows[6]["doc_type"], rows[6]["bank"], rows[6]["txn_count"], rows[6]["summary_confidence"]) == ("unknown", None, 0, 0)
    assert (rows[7]["doc_type"], rows[7]["status"]) == ("unreadable", "needs_review")
    assert (rows[8]["doc_type"], rows[8]["txn_count"], rows[8]["opening"], rows[8]["reconcile_reason"]) == ("bank_statement", 2, None, "missing_opening_or_ending_balance")
    assert len(rows) == len(DOCS)


def test_texts_are_dealt_once(spark, table):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = facts.document_facts(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # Solved equations come from a union, which has no dealing; all else finds its rows in the buckets.
    assert plan.count("Exchange hashpartitioning") <= 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def corrections_of(spark):
    return spark.createDataFrame([(1, 2, "direction", "debit", 1), (1, 1, "amount", "70.00", 1), (1, 1, "amount", "80.00", 2), (8, 2, "direction", "credit", 1)], "doc_id long, txn_no long, field string, value string, corrected_no int")


def test_corrections_touch_only_their_documents(spark, tmp_path, table, found):
    txns = store.kept(statements.parse_transactions(table.where("not is_form").select("doc_id", "raw_text", "statement_year")))
    fixes = corrections_of(spark)
    path = str(tmp_path / "facts")
    facts.save_facts(found, path, 16)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    touched = facts.correct_store(path, txns, fixes, 16)
    after = files()
    same = {f for f in before if before[f] == after.get(f)}
    assert touched and {f for f in before if not any(f"/part={p}/" in f for p in touched)} == same
    got = {r["doc_id"]: r.asDict() for r in spark.read.parquet(path).drop("part").collect()}
    want = {r["doc_id"]: r.asDict() for r in found.collect()}
    # A full recompute of every document's ledger from all corrected rows.
    full = {r["doc_id"]: r.asDict() for r in analytics.ledger_totals(facts.corrected_rows(txns, fixes)).collect()}
    for i, row in got.items():
        if i not in (1, 8):
            assert row == want[i]
        assert all(row[k] == full[i][k] for k in facts.LEDGER if i in full)
    assert (got[1]["true_revenue"], got[1]["reconciles"], got[1]["reconcile_reason"], got[1]["revenue_source"]) == (80.0, False, "mismatch", "transactions")
    assert got[1]["reconcile_difference"] == -120.0 and got[8]["review_ratio"] == 0.0 and want[8]["review_ratio"] == 0.5
    assert facts.correct_store(path, txns, fixes.limit(0), 16) == []


def test_recompute_reads_the_tables_once(spark, monkeypatch):
    """Statements are rendered once for facts, rows and corrections, which read tables that stand already."""
    from ledgerspark.plans import fact_queries

    rendered, given = [], {}

    def docs(spark, sf_dir, made=fact_queries.statement_docs):
        rendered.append(sf_dir)
        return made(spark, sf_dir)

    def recomputed(facts, txns, corrections):
        given.update(facts=facts, txns=txns, corrections=corrections)
        return facts

    monkeypatch.setattr(fact_queries, "statement_docs", docs)
    monkeypatch.setattr(fact_queries.facts, "recomputed", recomputed)
    monkeypatch.setattr(fact_queries.facts, "document_facts", lambda told: told.selectExpr("doc_id", *[f"null as {x}" for x in fact_queries.COLUMNS if x != "doc_id"]))
    fact_queries.recompute_facts(spark, "/root/testdata/sf0.001")
    assert len(rendered) == 1
    for name, df in given.items():
        assert not any("events.parquet" in x for x in df.inputFiles()), name

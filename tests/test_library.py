"""Golden cases and properties of the library's own operators."""

import datetime
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerspark.functions import text as T
from ledgerspark.operators import analytics as A
from ledgerspark.operators import leads as G
from ledgerspark.operators import statements as S
from ledgerspark.operators import verdicts as V
from ledgerspark.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("$1,234.56", 1234.56), ("(1,234.56)", -1234.56), ("-1,234.56", -1234.56), ("1,234.56-", -1234.56), ("", None), (None, None)])
def test_amounts(spark, text, want):
    got = one(spark, T.parse_amount(F.lit(text).cast("string")))
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("one_name, other, same", [("1950'S Original", "1950 ORIGINALS LLC", True), ("984, LLC", "984", True), ("G & S METAL PRODUCTS CO., INC.", "G&S Metal Products INC", False), ("Test Company LLC", "test", False)])
def test_company_keys(spark, one_name, other, same):
    assert (one(spark, T.company_key(F.lit(one_name))) == one(spark, T.company_key(F.lit(other)))) == same
    assert one(spark, T.company_key(F.lit(None).cast("string"))) == "unassociated"


def test_addresses(spark):
    assert one(spark, T.same_address(F.lit("1201 Richardson Drive, Richardson, TX 75080"), F.lit("1201 RICHARDSON DR STE 180, RICHARDSON, TX 75080-4610")))
    assert not one(spark, T.same_address(F.lit("1202 Richardson Drive, Richardson, TX 75080"), F.lit("1201 Richardson Drive, Richardson, TX 75080")))
    assert not one(spark, T.same_address(F.lit(None).cast("string"), F.lit("12 Main")))


def test_documents_and_contacts(spark):
    assert one(spark, T.document_kind(F.lit("Account Statement\nbeginning balance"))) == "bank_statement"
    assert one(spark, T.document_kind(F.lit("account statement"))) == "unknown"
    assert one(spark, T.document_kind(F.lit(" \n"))) == "unreadable"
    assert one(spark, T.is_contact_sheet(F.lit("Mobile\n(212) 555-0101\nsam@shop.org")))
    assert one(spark, T.phones(F.lit("212.555.0101 or 1 (212) 555-0101"))) == ["(212) 555-0101"]
    assert one(spark, T.masked_ssn(F.lit("SSN: 123-45-6789"))) == "XXX-XX-6789"
    assert one(spark, T.ein(F.lit("EIN 12-3456789"))) == "12-3456789"
    assert one(spark, T.stated_revenue(F.lit("Annual revenue: $1,200,000"))) == 100000
    assert [str(one(spark, T.parse_date(F.lit(x)))) for x in ("1/5/29", "1/5/30")] == ["2029-01-05", "1930-01-05"]


STATEMENT = """Account Summary
Daily balance
01-02 5,000.00
Deposits and other credits
01-02 CUSTOMER DEPOSIT 1,000.00 6,000.00
  wrapped name
01/03/26 WIRE 250.50
Total 1,250.50
stray line 9.99
Checks and other debits
CHECK 1042 01-05 19.79
01-06 CHECK 1042 19.79
New York office
01-07 REFUND CR 5.00
Money in
01-08 -7.00 ODD"""


def test_transactions(spark):
    docs = spark.createDataFrame([(1, STATEMENT), (2, None), (3, "")], "doc_id long, raw_text string")
    got = [(r.txn_id, r.date_text, r.description, r.amount and float(r.amount), r.direction, r.direction_source, r.running_balance and float(r.running_balance)) for r in S.parse_transactions(docs, 2026).orderBy("txn_no").collect()]
    assert got == [
        ("txn_1", "2026-01-02", "CUSTOMER DEPOSIT wrapped name", 1000.0, "credit", "section", 6000.0),
        ("txn_2", "2026-01-03", "WIRE", 250.5, "credit", "section", None),
        ("txn_3", "2026-01-05", "CHECK 1042", 19.79, "debit", "section", None),
        ("txn_5", "2026-01-07", "REFUND CR", 5.0, "credit", "tag", None),
        ("txn_6", "2026-01-08", "ODD", 7.0, "debit", "sign", None),
    ]


LEDGER = "doc_id long, txn_no long, txn_date date, description string, amount decimal(18,2), direction string, running_balance decimal(18,2)"


def test_analytics_handle_nulls_and_ties(spark):
    d = datetime.date(2026, 1, 5)
    rows = [(1, 1, d, None, Decimal("10.00"), "debit", None), (1, 2, None, "KAPITUS", Decimal("10.00"), "debit", Decimal("-1")), (1, 3, d, "KAPITUS", None, "debit", None), (1, 4, d, "NSF FEE", Decimal("5"), "debit", None), (1, 5, d, "NSF FEE", Decimal("5"), "debit", None), (2, 1, None, None, None, "needs_review", None)]
    t = spark.createDataFrame(rows, LEDGER)
    assert A.largest_debit(t).first().txn_no == 2
    assert A.nsf_events(t).count() == 1
    s = {r.doc_id: r for r in A.nsf_summary(t).collect()}
    assert (s[1].nsf_count, s[1].nsf_fees, s[1].negative_day_count, s[2].nsf_count) == (1, 5.0, 1, 0)
    p = A.advance_positions(t).collect()
    assert [(r.funder, r.n, r.cadence, r.status) for r in p] == [("Kapitus", 1, "review", "needs_review")]
    assert {r.doc_id: r.deposit_count for r in A.deposit_metrics(t).collect()} == {1: 0, 2: 0}
    for f in (A.deposit_metrics, A.expenses_by_category, A.largest_debit, A.recurring_expenses, A.nsf_summary, A.advance_positions, A.daily_cash_flow, A.daily_balance):
        assert f(t.limit(0)).count() == 0


def test_partitions_do_not_matter(spark):
    from ledgerspark.plans.registry import QUERIES

    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([sorted(map(str, QUERIES[q](spark, "/root/testdata/sf0.001").collect())) for q in ("advance_positions", "recurring_expenses", "lead_keys")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_duplicates_and_periods(spark):
    f = spark.createDataFrame([(1, "h", 5, 2), (2, "h", 5, 1), (3, "h", 6, 3), (4, None, 5, 4), (5, None, 5, 5)], "doc_id long, file_hash string, file_size long, arrival_no long")
    assert {r.doc_id: r.duplicate_of for r in G.mark_duplicates(f).collect()} == {1: 2, 2: None, 3: None, 4: None, 5: None}
    assert G.mark_duplicates(f, "skip").count() == 4
    v = spark.createDataFrame([(1, " A ", 2), (1, "a", 1), (1, "", 0), (1, None, 3), (1, "b", 4)], "lead long, value string, arrival_no long")
    assert [(r.value, r.place) for r in G.distinct_ci(v, ["lead"]).orderBy("place").collect()] == [("a", 1), ("b", 2)]


def test_corrections_keep_the_original(spark):
    t = spark.createDataFrame([(1, 1, Decimal("5"), "needs_review"), (1, 2, Decimal("6"), "debit")], "doc_id long, txn_no long, amount decimal(18,2), direction string")
    c = spark.createDataFrame([(1, 1, "direction", "credit", 1), (1, 1, "direction", "debit", 2)], "doc_id long, txn_no long, field string, value string, corrected_no int")
    got = {r.txn_no: (r.direction, r.original_direction, r.corrected) for r in V.apply_corrections(t, c).collect()}
    assert got == {1: ("debit", "needs_review", True), 2: ("debit", None, False)}


def test_files(spark, tmp_path):
    good = b"%PDF-1.4 ... startxref 9 %%EOF"
    (tmp_path / "a").mkdir()
    for name, data in (("a/one.pdf", good), ("two.PDF", b"%PDF-1.4 cut"), ("three.pdf", b"hello"), ("four.png", b"\x89PNG"), ("five.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.valid, r.reason, r.warnings, r.looks_corrupted) for r in files.validate_files(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {
        "one.pdf": (True, None, [], False), "two.PDF": (True, None, ["missing_eof_marker", "missing_startxref"], True), "three.pdf": (False, "not_a_real_pdf_signature", [], False),
        "four.png": (True, None, [], False),
    }
    more = spark.createDataFrame([("a.jpg", bytearray()), ("b.pdf", None), ("c.doc", bytearray(b"x"))], "path string, content binary").withColumn("length", F.length("content"))
    assert [r.reason for r in files.validate_files(more).orderBy("path").collect()] == ["empty_file", "empty_file", "unsupported_file_type"]


def test_rows_and_forms(spark):
    items = [("d", 1, 10.0, 700.0, 30.0, 10.0, "Legal Name"), ("d", 1, 200.0, 700.5, 30.0, 10.0, "Phone"), ("d", 1, 12.0, 686.0, 30.0, 10.0, "Acme"), ("d", 1, 201.0, 686.0, 30.0, 10.0, "555"), ("d", 1, 10.0, 600.0, 5.0, 10.0, "Wo"), ("d", 1, 15.2, 600.0, 5.0, 10.0, "rd")]
    df = spark.createDataFrame(items, "doc_id string, page int, x double, y double, width double, size double, text string")
    assert [r.line for r in files.form_rows_from_items(df).orderBy("row_no").collect()] == ["Legal Name Acme", "Phone 555", "Word"]
    assert [r.line for r in files.rows_from_items(df).orderBy("row_no").collect()] == ["Legal Name Phone", "Acme 555", "Word"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", ["deposit_metrics", "classify_documents", "build_leads", "parse_transactions"])
def test_oracles(spark, name):
    import duckdb

    from ledgerspark.plans.registry import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "events", "customer", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)

    def rows(values):
        return sorted(str([round(float(x), 6) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x for x in r]) for r in values)

    assert rows(got.select(columns).collect()) == rows(con.sql(ORACLE_SQL[name]).select(*columns).fetchall())


def test_positions_from_lines(spark):
    rows = [(1, 1, "Deposits and other credits"), (1, 2, "01/02 KAPITUS 500.00"), (1, 3, "Withdrawals"), (1, 4, "01/03 FORWARD FINANCING ID:993311 250.00 9,000.00"), (1, 5, "01/04 FORWARD FINANCING 250.00 8,750.00"), (1, 6, "note"), (1, 7, "01/05 FORWARD FINANCING credit funding 99.00"), (2, 1, None)]
    got = A.advance_positions_from_lines(spark.createDataFrame(rows, "doc_id long, line_no long, line string")).collect()
    assert [(r.doc_id, r.funder, r.typical_amount, r.n, r.cadence, r.monthly_burden, r.status) for r in got] == [(1, "Forward Financing", 250.0, 2, "daily", 7500.0, "verified")]


def test_banks_by_ordered_rules(spark):
    plain = "\n".join(f"plain row {i}" for i in range(40))
    rows = [(1, plain + "\nOld National", "a.pdf"), (2, plain + "\nhtb.com visionsfcu.org", "a.pdf"), (3, plain + "\nnano something ban", "a.pdf"), (4, "TD Bank\nTruist", "a.pdf"), (5, plain, "my cnb file.pdf"), (6, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, raw_text string, filename string")
    got = {r[0]: r[1] for r in d.select("doc_id", T.bank(F.col("raw_text"), F.col("filename"))).collect()}
    assert got == {1: "Old National Bank", 2: "HomeTrust Bank", 3: "Nano Banc", 4: "TD Bank", 5: "CNB", 6: None}


def test_holder_names_addresses_and_amounts(spark):
    from ledgerspark.operators import holders as H

    rows = [
        (1, "Some Bank\nACECMKMEIGOCICAAMGOAGCMK A-1 SERVICES GOES ANYWHERE LLC\n019749 808 BANKS AVE\nCLEVELAND OH 44127-1831 Online", None), (2, "ABBASPOUR INC IMCU now offers Visa cards.", None),
        (3, "ESTAFFLLC4812 ESTAFF LLC", None), (4, "04-13-2026 ZEL FROM AL MAWA LLC\nd/b/a Corner Shop", None), (5, None, None), (6, "Truist Holdings LLC\nAccount Holder: 984 LLC", "Truist"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, raw_text string, bank string")
    got = {r.doc_id: (r.legal_name, r.dba, r.evidence) for r in H.company_names(d).collect()}
    assert got == {
        1: ("A-1 SERVICES GOES ANYWHERE LLC", None, "entity_suffix"), 2: ("ABBASPOUR INC", None, "entity_suffix_split_row"), 3: ("ESTAFF LLC", None, "entity_suffix"),
        4: (None, "Corner Shop", "dba_only"), 5: (None, None, "none"), 6: ("984 LLC", None, "labelled"),
    }
    named = d.withColumn("name", F.when(F.col("doc_id") == 1, "A-1 SERVICES GOES ANYWHERE LLC"))
    assert {r.doc_id: r.full for r in H.holder_addresses(named).collect()} == {1: "808 BANKS AVE, CLEVELAND, OH 44127-1831"} | dict.fromkeys(range(2, 7))
    lines = spark.createDataFrame([(1, 1, "Deposits"), (1, 2, "(45.10) 2,026.00 12345678"), (1, 3, "3,000,000.00- and -5.00")], "doc_id long, line_no long, line string")
    near = {r.line_no: ([float(x) for x in r.amounts], r.next_amount, r.previous_line) for r in H.amounts_near(lines).collect()}
    assert near == {1: ([], near[1][1], None), 2: ([-45.10, 2026.0], near[2][1], None), 3: ([-3000000.0, -5.0], None, 2)}
    assert float(near[1][1]) == 45.10 and float(near[2][1]) == 3000000.0

"""Queries against their SQL on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import text as T
from ledgerspark.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query and of its SQL over tables made from (rows, schema)."""

    def both(name: str, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(ORACLE_SQL[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
        return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want))

    return both


ODD_LINES = ["4703443633947811 Achverber der stü", "12 Main plötzlich", "12é Main St", "12b Main St, ö9", "9 Side wayß Road, São Austin, TX 78753é", "Austin TX é78753", "PO Box 9é", "12 Main St, Austin, TX 78753-4610ü"]


def test_address_parts_beside_letters_of_other_alphabets(against_sql):
    got, want = against_sql("address_parts", documents=([(i, x) for i, x in enumerate([*ODD_LINES, "\n".join(ODD_LINES), None])], "doc_id long, text string"))
    assert got == want and any("stü" in r for r in got)


def test_words_end_at_letters_of_other_alphabets(spark):
    p = spark.range(1).select(T.address_parts(F.lit("12é Main, Austin TX 78753ü")).alias("p")).first().p
    assert (p.house, p.postcode, p.town) == ("12", "78753", "austin tx")


def test_directions_of_zero_negative_and_missing_amounts(against_sql):
    values = [0.0, -3.5, None, 12.25, 0.004]
    rows = [(u, 4 * i + u, "2026-01-05", "view", x) for i, x in enumerate(values * 6) for u in range(4)]
    got, want = against_sql("resolve_direction", events=(rows, "user_id long, event_id long, ts string, event_type string, value double"))
    assert got == want and len(got) == 120


def test_a_zero_has_no_sign(spark):
    from ledgerspark.operators.statements import resolve_direction

    d = spark.range(1).select(resolve_direction(F.lit("-0.00").cast("decimal(18,2)"), F.lit("CHECK 1042"), F.lit(None)).alias("d")).first().d
    assert tuple(d) == ("debit", "keyword")


def test_typical_amounts_of_ties_and_even_groups(against_sql):
    amounts = [[5.0, 5.0, 7.25, 7.25], [3.33, 3.33, 9.0, 9.0, 8.0, 8.0], [1.01, 2.02], [1.0, 2.0, 4.5], [None, 6.1], [0.01] * 3 + [0.5] * 3, [2.5, 2.5, 1.5, 1.5, None]]
    rows = [(u, 28 * (100 * u + i) + 4, f"2026-01-{i + 1:02d}", "click", x) for u, group in enumerate(amounts) for i, x in enumerate(group)]
    for name in ("typical_amount", "advance_positions"):
        got, want = against_sql(name, events=(rows, "user_id long, event_id long, ts string, event_type string, value double"))
        assert got == want and len(got) == len(amounts)


def test_positions_read_the_ledger_once_and_compile(spark, capfd):
    """One scan of a ledger, no map of amounts, and code that fits a JVM method."""
    from ledgerspark.operators import analytics as A

    rows = spark.range(400).selectExpr("id % 40 as doc_id", "id as txn_no", "date'2026-01-05' as txn_date", "'KAPITUS DAILY PMT' as description", "cast(id % 7 as decimal(18,2)) as amount", "'debit' as direction")
    positions = A.advance_positions(rows)
    plan = positions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "percentile" not in plan
    capfd.readouterr()
    assert positions.count() == 40 and "Failed to compile" not in "".join(capfd.readouterr())

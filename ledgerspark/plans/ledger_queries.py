"""Queries over the ledgers derived from events (dense) and lineitem (large), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.money import MONEY
from ..operators import analytics as A
from ..sources.bridge import BIG_LEDGER_SQL, LEDGER_SQL, big_ledger, ledger, sql_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, ledgers: str = LEDGER_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {ledgers}{sql}" if sql.lstrip().startswith(",") else f"WITH {ledgers}\n{sql}"
        return f

    return add


def case(rules, value: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, {sql_text(p)}) THEN {sql_text(n)}" for n, p in rules) + f" ELSE {otherwise} END"


def contains(value: str, words) -> str:
    return "(" + " OR ".join(f"contains({value}, {sql_text(w)})" for w in words) + ")"


def r2(x: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 100 + 0.5) / 100"


def per(total: str, n: str) -> str:
    """Whole cents over a number, ties up."""
    return f"floor((2 * CAST({total} * 100 AS BIGINT) + {n}) / (2 * {n})) / 100"


KIND = f"""CASE WHEN direction <> 'credit' OR amount IS NULL THEN NULL WHEN regexp_matches(description, {sql_text(L.TRANSFER)}) THEN 'transfer'
 WHEN regexp_matches(description, {sql_text(L.REVERSAL)}) THEN 'reversal' WHEN {contains('lower(description)', [f.lower() for f, _ in L.FUNDERS])} AND regexp_matches(description, {sql_text(L.FINANCING)}) THEN 'financing' ELSE 'revenue' END"""
DEPOSITS = f"""k AS (SELECT *, {KIND} AS kind FROM ledger),
deposits AS (SELECT doc_id, CAST(coalesce(sum(amount) FILTER (kind IS NOT NULL), 0) AS DOUBLE) AS gross_deposits, CAST(coalesce(sum(amount) FILTER (kind = 'revenue'), 0) AS DOUBLE) AS true_revenue,
 count(kind) AS deposit_count, CAST(coalesce(max(amount) FILTER (kind IS NOT NULL), 0) AS DOUBLE) AS largest_deposit, CAST(coalesce(min(amount) FILTER (kind IS NOT NULL), 0) AS DOUBLE) AS smallest_deposit,
 {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_count, CAST(coalesce(sum(amount) FILTER (kind = '{k}'), 0) AS DOUBLE) AS {k}_amount" for k in ('transfer', 'reversal', 'financing'))},
 CASE WHEN count(kind) > 0 THEN {per('sum(amount) FILTER (kind IS NOT NULL)', 'count(kind)')} ELSE 0.0 END AS average_deposit,
 {r2("coalesce(sum(amount) FILTER (kind IS NOT NULL), 0) - coalesce(sum(amount) FILTER (kind = 'revenue'), 0)")} AS removed FROM k GROUP BY doc_id)"""


@query(f", {DEPOSITS} SELECT * FROM deposits")
def deposit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deposit_metrics(ledger(spark, sf_dir))


@query(f", {DEPOSITS} SELECT * FROM deposits", BIG_LEDGER_SQL)
def deposit_metrics_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deposit_metrics(big_ledger(spark, sf_dir))


def _facts(txns: DataFrame) -> DataFrame:
    """Every third document truncated, every second with a printed total of its credits."""
    credit = F.sum(F.when(F.col("direction") == "credit", F.col("amount"))).cast("double")
    n = F.col("doc_id")
    return txns.groupBy("doc_id").agg(credit.alias("c")).select("doc_id", (n % 3 == 0).alias("truncated"), F.when(n % 2 == 0, F.col("c")).alias("bank_deposits"))


REVENUE = f"""{DEPOSITS}, facts AS (SELECT doc_id, doc_id % 3 = 0 AS truncated, CASE WHEN doc_id % 2 = 0 THEN CAST(sum(amount) FILTER (direction = 'credit') AS DOUBLE) END AS bank_deposits FROM ledger GROUP BY doc_id),
revenue AS (SELECT doc_id, CASE WHEN NOT truncated AND true_revenue > 0 THEN true_revenue ELSE coalesce(bank_deposits, true_revenue) END AS revenue,
 CASE WHEN NOT truncated AND true_revenue > 0 THEN 'transactions' WHEN bank_deposits IS NOT NULL THEN 'bank_total' ELSE 'transactions' END AS revenue_source,
 coalesce(bank_deposits, gross_deposits) AS total_deposits FROM deposits JOIN facts USING (doc_id))"""


@query(f", {REVENUE} SELECT * FROM revenue")
def choose_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir)
    return A.choose_revenue(A.deposit_metrics(t), _facts(t))


CATEGORY = case(L.CATEGORIES, "description", sql_text(L.OTHER_CATEGORY))
DEBITS = "debits AS (SELECT * FROM ledger WHERE direction = 'debit' AND amount IS NOT NULL)"


@query(f", {DEBITS} SELECT doc_id, txn_no, CAST(amount AS DOUBLE) AS amount, {CATEGORY} AS category FROM debits")
def categorise_expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.categorise_expense(ledger(spark, sf_dir)).select("doc_id", "txn_no", F.col("amount").cast("double").alias("amount"), "category")


@query(f", {DEBITS} SELECT doc_id, {CATEGORY} AS category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM debits GROUP BY 1, 2")
def expenses_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.expenses_by_category(ledger(spark, sf_dir))


@query(f", {DEBITS} SELECT doc_id, {CATEGORY} AS category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM debits GROUP BY 1, 2", BIG_LEDGER_SQL)
def expenses_by_category_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.expenses_by_category(big_ledger(spark, sf_dir))


@query(f""", {DEBITS}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY amount DESC, txn_no DESC) AS p, CAST(sum(amount) OVER (PARTITION BY doc_id) AS DOUBLE) AS total_debits, count(*) OVER (PARTITION BY doc_id) AS debit_count FROM debits)
SELECT doc_id, txn_no, CAST(amount AS DOUBLE) AS amount, description, total_debits, debit_count FROM placed WHERE p = 1""")
def largest_debit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.largest_debit(ledger(spark, sf_dir))


@query(f""", {DEBITS}, keyed AS (SELECT *, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(description), '\\d{{3,}}', '', 'g'), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), 1, 3), ' ') AS counterparty FROM debits),
g AS (SELECT doc_id, counterparty, count(*) AS n, sum(amount) AS total, min_by({CATEGORY}, txn_no) AS category, min(txn_no) AS first FROM keyed GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, counterparty, category, n, {per('total', 'n')} AS average_amount, CAST(total AS DOUBLE) AS total_amount, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, first) AS place FROM g""")
def recurring_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recurring_expenses(ledger(spark, sf_dir))


EVENTS = f"""kinds AS (SELECT *, {case(L.EVENT_KINDS, 'description', 'NULL')} AS kind FROM ledger),
found AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, txn_date, amount ORDER BY txn_no) AS p FROM kinds WHERE kind IS NOT NULL)"""


@query(f", {EVENTS} SELECT doc_id, kind, CAST(txn_date AS VARCHAR) AS txn_date, CAST(coalesce(amount, 0) AS DOUBLE) AS amount, txn_no, description AS evidence FROM found WHERE p = 1")
def nsf_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nsf_events(ledger(spark, sf_dir)).withColumn("txn_date", F.col("txn_date").cast("string"))


@query(f""", {EVENTS}, e AS (SELECT doc_id, count(*) FILTER (kind = 'nsf') AS nsf_count, count(*) FILTER (kind = 'overdraft') AS overdraft_count, count(*) FILTER (kind = 'returned') AS returned_count,
 CAST(sum(amount) FILTER (kind = 'nsf') AS DOUBLE) AS nsf_fees, CAST(sum(amount) FILTER (kind = 'overdraft') AS DOUBLE) AS overdraft_fees FROM found WHERE p = 1 GROUP BY 1),
d AS (SELECT doc_id, count(DISTINCT txn_date) FILTER (running_balance < 0) AS negative_day_count FROM balanced GROUP BY 1)
SELECT d.doc_id, negative_day_count, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('nsf_count', 'overdraft_count', 'returned_count', 'nsf_fees', 'overdraft_fees'))} FROM d LEFT JOIN e USING (doc_id)""")
def nsf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nsf_summary(ledger(spark, sf_dir, balance=True))


FUNDER = f"""CASE WHEN {contains('d', L.NOT_ADVANCES)} OR (contains(d, 'capital one') AND NOT regexp_matches(d, {sql_text(L.BANK_LOAN_WORDS)})) THEN NULL
 {' '.join(f"WHEN {contains('d', words)} THEN {sql_text(n)}" for n, words in L.FUNDERS)} WHEN {contains('d', L.GENERIC_TERMS)} THEN {sql_text(L.GENERIC_FUNDER)} END"""
MATCHED = f"matched AS (SELECT * FROM (SELECT *, {FUNDER} AS funder FROM (SELECT *, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS d FROM ledger)) WHERE funder IS NOT NULL)"


@query(f", {MATCHED} SELECT doc_id, txn_no, funder FROM matched")
def match_funder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.match_funder(ledger(spark, sf_dir)).where("funder is not null").select("doc_id", "txn_no", "funder")


def cadence_sql(n: str, dates: str, first: str, last: str) -> str:
    gap = f"datediff('day', {first}, {last}) / ({dates} - 1)"
    return f"CASE WHEN {dates} >= 2 THEN CASE WHEN {gap} <= 2 THEN 'daily' WHEN {gap} <= 9 THEN 'weekly' WHEN {gap} <= 35 THEN 'monthly' ELSE 'irregular' END WHEN {n} >= 30 THEN 'daily' WHEN {n} >= 4 THEN 'weekly' WHEN {n} >= 2 THEN 'recurring' ELSE 'review' END"


@query(f""", {MATCHED}, g AS (SELECT doc_id, funder, count(*) AS n, count(txn_date) AS dates, min(txn_date) AS first_date, max(txn_date) AS last_date FROM matched GROUP BY 1, 2)
SELECT doc_id, funder, n, {cadence_sql('n', 'dates', 'first_date', 'last_date')} AS cadence FROM g""")
def classify_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.match_funder(ledger(spark, sf_dir)).where("funder is not null")
    return A.classify_cadence(t, ["doc_id", "funder"]).select("doc_id", "funder", "n", "cadence")


TYPICAL = f"""debited AS (SELECT * FROM matched WHERE direction = 'debit' AND amount IS NOT NULL),
c AS (SELECT doc_id, funder, amount, count(*) AS times, min(txn_no) AS first FROM debited GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, funder ORDER BY times DESC, CASE WHEN amount = floor(amount) THEN 0 ELSE 1 END, CASE WHEN amount = floor(amount) THEN amount ELSE 0 END, first) AS p FROM c),
typical AS (SELECT m.doc_id, m.funder, CASE WHEN o.times >= 2 THEN CAST(o.amount AS DOUBLE) ELSE {r2('round(m.middle, 6)')} END AS typical_amount
 FROM (SELECT doc_id, funder, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS middle FROM debited GROUP BY 1, 2) m JOIN o ON o.doc_id = m.doc_id AND o.funder = m.funder AND o.p = 1)"""


@query(f", {MATCHED}, {TYPICAL} SELECT * FROM typical")
def typical_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.match_funder(A.debits(ledger(spark, sf_dir))).where("funder is not null")
    return A.typical_amount(t, ["doc_id", "funder"])


POSITIONS = f"""{MATCHED}, {TYPICAL}, g AS (SELECT doc_id, funder, count(*) AS n, count(txn_date) AS dates, min(txn_date) AS first_date, max(txn_date) AS last_date FROM debited GROUP BY 1, 2),
h AS (SELECT *, {cadence_sql('n', 'dates', 'first_date', 'last_date')} AS cadence, CASE WHEN dates < 2 THEN 1.0 ELSE greatest(1.0, {r2("datediff('day', first_date, last_date) / 30")}) END AS months FROM g JOIN typical USING (doc_id, funder)),
positions AS (SELECT doc_id, funder, typical_amount, cadence, first_date, last_date, n,
 {r2("round(CASE cadence WHEN 'daily' THEN typical_amount * 30 WHEN 'weekly' THEN typical_amount * 4.33 WHEN 'monthly' THEN typical_amount ELSE typical_amount * n / months END, 6)")} AS monthly_burden,
 CASE WHEN n >= 2 OR funder = 'DoorDash Capital' THEN 'verified' ELSE 'needs_review' END AS status FROM h)"""


@query(f", {POSITIONS} SELECT * REPLACE (CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date) FROM positions")
def advance_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.advance_positions(ledger(spark, sf_dir))
    return p.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(f", {POSITIONS} SELECT * REPLACE (CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date) FROM positions", BIG_LEDGER_SQL)
def advance_positions_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.advance_positions(big_ledger(spark, sf_dir))
    return p.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


MERGED = f"""{POSITIONS}, lists AS (SELECT doc_id, funder, n, monthly_burden, status, 1 AS l FROM positions WHERE n % 3 <> 0 UNION ALL
 SELECT doc_id, upper(funder), n + 1, monthly_burden, CASE WHEN n % 2 = 0 THEN status ELSE 'needs_review' END, 2 FROM positions),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(funder) ORDER BY CASE WHEN status = 'verified' THEN 1000 ELSE 0 END + n * 10 + monthly_burden / 100000 DESC, l) AS p FROM lists) WHERE p = 1)"""


@query(f", {MERGED} SELECT doc_id, funder, n, monthly_burden, status FROM merged")
def merge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.advance_positions(ledger(spark, sf_dir)).select("doc_id", "funder", "n", "monthly_burden", "status")
    other = p.select("doc_id", F.upper("funder").alias("funder"), (F.col("n") + 1).alias("n"), "monthly_burden", F.when(F.col("n") % 2 == 0, F.col("status")).otherwise("needs_review").alias("status"))
    return A.merge_positions(p.where("n % 3 <> 0"), other)


@query(f""", {POSITIONS}, {DEPOSITS}, s AS (SELECT doc_id, count(*) AS position_count, CAST(sum(CAST(monthly_burden AS DECIMAL(18,2))) AS DOUBLE) AS total_burden FROM positions GROUP BY 1)
SELECT d.doc_id, coalesce(position_count, 0) AS position_count, coalesce(total_burden, 0.0) AS total_burden, CASE WHEN true_revenue <> 0 THEN {r2('round(coalesce(total_burden, 0.0) / true_revenue, 6)')} END AS burden_ratio, coalesce(position_count, 0) >= 2 AS stacked FROM deposits d LEFT JOIN s USING (doc_id)""")
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir)
    return A.stacking(A.advance_positions(t), A.deposit_metrics(t).select("doc_id", F.col("true_revenue").alias("revenue")))


FLOW = f"""g AS (SELECT doc_id, coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS d, greatest(count(DISTINCT txn_date), 1) AS n FROM ledger GROUP BY 1)
SELECT doc_id, {per('c', 'n')} AS average_daily_inflow, {per('d', 'n')} AS average_daily_outflow, {per('(c - d)', 'n')} AS net_daily_cash_flow, n AS active_day_count FROM g"""


@query(f", {FLOW}")
def daily_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_cash_flow(ledger(spark, sf_dir))


@query(f", {FLOW}", BIG_LEDGER_SQL)
def daily_cash_flow_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_cash_flow(big_ledger(spark, sf_dir))


@query(f"""SELECT doc_id, count(running_balance) > 0 AS available, {per('sum(running_balance)', 'count(running_balance)')} AS average_daily_balance, CAST(min(running_balance) AS DOUBLE) AS lowest_balance,
 CAST(max(running_balance) AS DOUBLE) AS highest_balance, count(DISTINCT txn_date) FILTER (running_balance < 0) AS negative_day_count, count(running_balance) AS sampled_days FROM balanced GROUP BY 1""")
def daily_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_balance(ledger(spark, sf_dir, balance=True))


@query(""", s AS (SELECT account AS doc_id, year(txn_date) AS period, CAST(sum(amount) AS DOUBLE) AS value FROM ledger WHERE direction = 'credit' GROUP BY 1, 2),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY doc_id ORDER BY period) AS step FROM s),
g AS (SELECT doc_id, count(*) AS periods, min(step) AS low, max(step) AS high, avg(abs(step)) AS moved, avg(value) AS mean FROM d GROUP BY 1)
SELECT doc_id, CASE WHEN periods < 2 THEN 'insufficient_data' WHEN low > 0 THEN 'increasing' WHEN high < 0 THEN 'decreasing' WHEN mean > 0 AND moved / mean > 0.25 THEN 'irregular' ELSE 'stable' END AS trend, periods FROM g""", BIG_LEDGER_SQL)
def revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = big_ledger(spark, sf_dir).where("direction = 'credit'")
    return A.revenue_trend(t.groupBy(F.col("account").alias("doc_id"), F.year("txn_date").alias("period")).agg(F.sum("amount").cast("double").alias("value")))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per account and week of the dense ledger: opening and ending balance, every seventh opening a dollar off."""
    t = ledger(spark, sf_dir, balance=True).withColumn("week", F.weekofyear("txn_date"))
    g = t.groupBy("doc_id", "week").agg(F.max_by("running_balance", "txn_no").alias("ending"))
    before = F.lag("ending").over(Window.partitionBy("doc_id").orderBy("week"))
    opening = F.coalesce(before, F.lit(0)) + F.when((F.col("doc_id") + F.col("week")) % 7 == 0, 1).otherwise(0)
    return g.select(F.col("doc_id").alias("account"), F.col("week").alias("period_end"), opening.cast(MONEY).alias("opening"), F.col("ending").cast(MONEY).alias("ending"))


WEEKS = """w AS (SELECT doc_id AS account, weekofyear(txn_date) AS period_end, max_by(running_balance, txn_no) AS ending FROM balanced GROUP BY 1, 2),
statements AS (SELECT account, period_end, coalesce(lag(ending) OVER (PARTITION BY account ORDER BY period_end), 0) + CASE WHEN (account + period_end) % 7 = 0 THEN 1 ELSE 0 END AS opening, ending FROM w)"""


@query(f""", {WEEKS}, c AS (SELECT *, lag(ending) OVER (PARTITION BY account ORDER BY period_end) AS previous_ending FROM statements)
SELECT account, period_end, CAST(opening AS DOUBLE) AS opening, CAST(ending AS DOUBLE) AS ending, CAST(previous_ending AS DOUBLE) AS previous_ending, CAST(CASE WHEN previous_ending IS NOT NULL THEN abs(opening - previous_ending) <= 0.02 END AS VARCHAR) AS continues FROM c""")
def chain_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.chain_continuity(_statements(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("double") for c in ("opening", "ending", "previous_ending")}).withColumns({"period_end": F.col("period_end").cast("long"), "continues": F.col("continues").cast("string")})


def _balances(t: DataFrame) -> DataFrame:
    """Statement facts that take every branch: doc_id mod 6 decides."""
    n = F.col("doc_id")
    net = F.sum(F.when(F.col("direction") == "credit", F.col("amount")).when(F.col("direction") == "debit", -F.col("amount")).otherwise(F.lit(0)))
    credit, debit = (F.sum(F.when(F.col("direction") == k, F.col("amount")).otherwise(F.lit(0))).cast(MONEY) for k in ("credit", "debit"))
    g = t.groupBy("doc_id").agg(net.cast(MONEY).alias("net"), credit.alias("c"), debit.alias("d"))
    hundred = F.lit(100).cast(MONEY)
    kind = n % 6
    return g.select(
        "doc_id", F.when(kind != 3, hundred).alias("opening"), (hundred + F.col("net") + F.when(kind == 5, 3).otherwise(0)).cast(MONEY).alias("ending"), (kind == 0).alias("verified"),
        hundred.alias("eq_beginning"), F.when(kind <= 1, (hundred + F.col("net")).cast(MONEY)).alias("eq_ending"), F.when(kind <= 1, F.col("c")).alias("eq_deposits"),
        F.when(kind <= 1, F.col("d")).alias("eq_withdrawals"), F.when(kind == 1, F.lit(2.5)).alias("eq_difference"), (kind == 2).alias("truncated"),
    )


@query(""", g AS (SELECT doc_id, doc_id % 6 AS kind, coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS d FROM ledger GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN kind = 0 THEN true WHEN kind IN (1, 2, 3) THEN NULL ELSE kind <> 5 END AS VARCHAR) AS reconciles,
CAST(CASE WHEN kind IN (2, 3) THEN NULL ELSE 100 + c - d END AS DOUBLE) AS expected_ending, CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2.5 WHEN 4 THEN 0 WHEN 5 THEN -3 END AS DOUBLE) AS difference,
CAST(c AS DOUBLE) AS total_credits, CAST(d AS DOUBLE) AS total_debits, CASE WHEN kind <= 1 THEN 'statement_balance_equation' ELSE 'transactions' END AS source,
CASE kind WHEN 1 THEN 'equation_not_provable' WHEN 2 THEN 'statement_truncated' WHEN 3 THEN 'missing_opening_or_ending_balance' WHEN 5 THEN 'mismatch' ELSE 'ok' END AS reason FROM g""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir)
    return A.reconcile(t, _balances(t)).withColumn("reconciles", F.col("reconciles").cast("string"))

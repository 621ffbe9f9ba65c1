"""Ledger analytics: deposits, expenses, overdrafts, cash advances, cash flow and trends.

Inputs are ledger rows: doc_id, txn_no (a total order within a document), txn_date, description,
amount (DECIMAL, may be null), direction (credit, debit, needs_review) and, for some, running_balance. Null
descriptions match no rule. Outputs are one row per document or per document and group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.money import MONEY, amount_when, count_when, ratio2, round2


def text(column: str = "description") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def first_match(rules: list[tuple[str, str]], value: Column, otherwise: Column) -> Column:
    """The name of the first pattern that the value has."""
    return functools.reduce(lambda rest, rule: F.when(value.rlike(rule[1]), rule[0]).otherwise(rest), reversed(rules), otherwise)


def has_any(value: Column, words: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [value.contains(w) for w in words])


def normal(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


# -- deposits -----------------------------------------------------------------------------------


def deposit_kind(description: Column) -> Column:
    """transfer, reversal, financing or revenue, tried in this order."""
    names = [a.lower() for a, _ in L.FUNDERS]
    financing = has_any(F.lower(description), names) & description.rlike(L.FINANCING)
    return F.when(description.rlike(L.TRANSFER), "transfer").when(description.rlike(L.REVERSAL), "reversal").when(financing, "financing").otherwise("revenue")


def deposit_metrics(txns: DataFrame) -> DataFrame:
    """Gross and true deposits per document, and what was left out of the latter."""
    t = txns.withColumn("kind", F.when((F.col("direction") == "credit") & F.col("amount").isNotNull(), deposit_kind(text())))
    credit, amount = F.col("kind").isNotNull(), F.col("amount")
    g = t.groupBy("doc_id").agg(
        amount_when(credit, amount).alias("gross_deposits"), amount_when(F.col("kind") == "revenue", amount).alias("true_revenue"), count_when(credit).alias("deposit_count"),
        F.coalesce(F.max(F.when(credit, amount)), F.lit(0)).cast("double").alias("largest_deposit"), F.coalesce(F.min(F.when(credit, amount)), F.lit(0)).cast("double").alias("smallest_deposit"),
        F.sum(F.when(credit, amount)).alias("total"),
        *[x for k in ("transfer", "reversal", "financing") for x in (count_when(F.col("kind") == k).alias(f"{k}_count"), amount_when(F.col("kind") == k, amount).alias(f"{k}_amount"))],
    )
    average = F.when(F.col("deposit_count") > 0, ratio2(F.col("total"), F.col("deposit_count"))).otherwise(F.lit(0.0))
    return g.withColumns({"average_deposit": average, "removed": round2(F.col("gross_deposits") - F.col("true_revenue"))}).drop("total")


def choose_revenue(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """Revenue and where it's from: the rows unless truncated or zero, then the bank's total, then the rows.

    facts: doc_id, truncated, bank_deposits (null: not printed)."""
    m = metrics.join(facts, "doc_id", "left")
    by_rows = ~F.coalesce("truncated", F.lit(False)) & (F.col("true_revenue") > 0)
    return m.select(
        "doc_id", F.when(by_rows, F.col("true_revenue")).otherwise(F.coalesce(F.col("bank_deposits").cast("double"), F.col("true_revenue"))).alias("revenue"),
        F.when(by_rows, "transactions").when(F.col("bank_deposits").isNotNull(), "bank_total").otherwise("transactions").alias("revenue_source"),
        F.coalesce(F.col("bank_deposits").cast("double"), F.col("gross_deposits")).alias("total_deposits"),
    )


# -- expenses -----------------------------------------------------------------------------------


def debits(txns: DataFrame) -> DataFrame:
    return txns.where((F.col("direction") == "debit") & F.col("amount").isNotNull())


def category(description: Column) -> Column:
    return first_match(L.CATEGORIES, description, F.lit(L.OTHER_CATEGORY))


def categorise_expense(txns: DataFrame) -> DataFrame:
    return debits(txns).withColumn("category", category(text()))


def expenses_by_category(txns: DataFrame) -> DataFrame:
    g = categorise_expense(txns).groupBy("doc_id", "category")
    return g.agg(F.count("*").cast("long").alias("n"), F.sum("amount").cast("double").alias("total"))


def largest_debit(txns: DataFrame) -> DataFrame:
    """The largest debit of each document (the last on a tie), the debits' number and total."""
    top = F.max_by(F.struct("txn_no", "amount", "description"), F.struct("amount", "txn_no"))
    g = debits(txns).groupBy("doc_id").agg(top.alias("top"), F.sum("amount").cast("double").alias("total_debits"), F.count("*").cast("long").alias("debit_count"))
    return g.select("doc_id", F.col("top.txn_no").alias("txn_no"), F.col("top.amount").cast("double").alias("amount"), F.col("top.description").alias("description"), "total_debits", "debit_count")


def counterparty(description: Column) -> Column:
    """Lower case without long numbers and signs; the first three words."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(description), r"\d{3,}", ""), r"[^a-z\s]", ""), r"\s+", " "))
    return F.array_join(F.slice(F.split(words, " "), 1, 3), " ")


def recurring_expenses(txns: DataFrame) -> DataFrame:
    """Counterparties with two debits or more; place 1 is the document's largest recurring expense."""
    t = debits(txns).withColumn("counterparty", counterparty(text()))
    g = t.groupBy("doc_id", "counterparty").agg(F.count("*").cast("long").alias("n"), F.sum("amount").alias("total"), F.min_by(category(text()), "txn_no").alias("category"), F.min("txn_no").alias("first"))
    g = g.where("n >= 2")
    order = Window.partitionBy("doc_id").orderBy(F.desc("total"), "first")
    return g.select("doc_id", "counterparty", "category", "n", ratio2(F.col("total"), F.col("n")).alias("average_amount"), F.col("total").cast("double").alias("total_amount"), F.row_number().over(order).cast("long").alias("place"))


# -- overdrafts ---------------------------------------------------------------------------------


def nsf_events(txns: DataFrame) -> DataFrame:
    """Overdraft events, one per kind, date and amount (nulls are equal): the first row of each."""
    t = txns.withColumn("kind", first_match(L.EVENT_KINDS, text(), F.lit(None).cast("string"))).where("kind is not null")
    g = t.groupBy("doc_id", "kind", "txn_date", "amount").agg(F.min("txn_no").alias("txn_no"), F.min_by("description", "txn_no").alias("evidence"))
    return g.select("doc_id", "kind", "txn_date", F.coalesce("amount", F.lit(0)).cast("double").alias("amount"), "txn_no", "evidence")


def nsf_summary(txns: DataFrame) -> DataFrame:
    """Numbers and fees by kind, and the distinct dates with a balance below zero."""
    e = nsf_events(txns).groupBy("doc_id").agg(
        *[count_when(F.col("kind") == k).alias(f"{k}_count") for k in ("nsf", "overdraft", "returned")],
        *[amount_when(F.col("kind") == k, F.col("amount").cast(MONEY)).alias(f"{k}_fees") for k in ("nsf", "overdraft")],
    )
    below = F.when(F.col("running_balance") < 0, F.coalesce(F.col("txn_date").cast("string"), F.lit("none")))
    days = txns.groupBy("doc_id").agg(F.countDistinct(below).cast("long").alias("negative_day_count"))
    return days.join(e, "doc_id", "left").fillna(0)


# -- cash advances ------------------------------------------------------------------------------


def funder(description: Column) -> Column:
    """The funder that a description names; null for none, an exclusion or a plain Capital One payment."""

    def named(d: Column) -> Column:
        name = functools.reduce(lambda rest, f: F.when(has_any(d, f[1]), f[0]).otherwise(rest), reversed(L.FUNDERS), F.when(has_any(d, L.GENERIC_TERMS), L.GENERIC_FUNDER))
        plain = d.contains("capital one") & ~d.rlike(L.BANK_LOAN_WORDS)
        return F.when(~has_any(d, L.NOT_ADVANCES) & ~plain, name)

    return T.let(normal(description), named)  # else a filter normalizes it for each word, in more code than a JVM method holds


def match_funder(txns: DataFrame) -> DataFrame:
    return txns.withColumn("funder", funder(text()))


def cadence(count: Column, dates: Column, first: Column, last: Column) -> Column:
    """From the mean gap of the dates (it telescopes to the span over the gaps), else from the number alone."""
    gap = F.datediff(last, first) / (dates - 1)
    by_gap = F.when(gap <= 2, "daily").when(gap <= 9, "weekly").when(gap <= 35, "monthly").otherwise("irregular")
    by_count = F.when(count >= 30, "daily").when(count >= 4, "weekly").when(count >= 2, "recurring").otherwise("review")
    return F.when(dates >= 2, by_gap).otherwise(by_count)


def classify_cadence(txns: DataFrame, keys: list[str]) -> DataFrame:
    g = txns.groupBy(*keys).agg(F.count("*").cast("long").alias("n"), F.count("txn_date").alias("dates"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"))
    return g.withColumn("cadence", cadence(F.col("n"), F.col("dates"), F.col("first_date"), F.col("last_date")))


def payments(txns: DataFrame, keys: list[str]) -> DataFrame:
    """A row per keys: n, dates, first_date, last_date and typical_amount, which is the amount that repeats most, else the median.
    Of equally frequent amounts, whole ones ascending come first, then the first seen.

    Rows are read once and counted per amount first, so no list or map of amounts is gathered; medians are places in a window."""
    per = txns.groupBy(*keys, "amount").agg(F.count("*").alias("times"), F.min("txn_no").alias("first"), F.count("txn_date").alias("dates"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"))
    c, whole = F.col, F.col("amount") == F.floor("amount")
    order = Window.partitionBy(*keys).orderBy("amount")
    before, group = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.when(c("amount").isNotNull(), c("times")).otherwise(0)
    per = per.withColumns({"upto": F.sum(known).over(before), "known": F.sum(known).over(group), "most": F.max("times").over(group)})

    def at(place: Column) -> Column:
        return F.max(F.when(c("amount").isNotNull() & (place < c("upto")) & (place >= c("upto") - c("times")), c("amount").cast("double")))

    often = c("times") == c("most")
    g = per.groupBy(*keys).agg(
        F.sum("times").alias("n"), F.sum("dates").alias("dates"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("most").alias("most"),
        F.coalesce(F.min(F.when(often & whole, c("amount"))), F.min_by("amount", F.when(often, c("first")))).alias("mode"),
        at(F.floor((c("known") - 1) / 2)).alias("low"), at(F.floor(c("known") / 2)).alias("high"),
    )
    typical = F.when(c("most") >= 2, c("mode").cast("double")).otherwise(round2(F.round(0.5 * c("low") + 0.5 * c("high"), 6)))
    return g.select(*keys, "n", "dates", "first_date", "last_date", typical.alias("typical_amount"))


def typical_amount(txns: DataFrame, keys: list[str]) -> DataFrame:
    """The amount that repeats most, else the median (see payments)."""
    return payments(txns, keys).select(*keys, "typical_amount")


def advance_positions(txns: DataFrame) -> DataFrame:
    """One row per document and funder: payments, cadence, monthly burden and status."""
    g = payments(match_funder(debits(txns)).where("funder is not null"), ["doc_id", "funder"])
    g = g.withColumn("cadence", cadence(F.col("n"), F.col("dates"), F.col("first_date"), F.col("last_date")))
    days = F.datediff("last_date", "first_date")
    months = F.when(F.col("dates") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), round2(days / 30)))
    a = F.col("typical_amount")
    burden = F.when(F.col("cadence") == "daily", a * 30).when(F.col("cadence") == "weekly", a * 4.33).when(F.col("cadence") == "monthly", a).otherwise(a * F.col("n") / months)
    status = F.when((F.col("n") >= 2) | (F.col("funder") == "DoorDash Capital"), "verified").otherwise("needs_review")
    return g.select("doc_id", "funder", a, "cadence", "first_date", "last_date", "n", round2(F.round(burden, 6)).alias("monthly_burden"), status.alias("status"))


def merge_positions(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two position lists by lower-case funder: the better ranked, the first list's on a tie."""
    both = first.withColumn("list_no", F.lit(1)).unionByName(second.withColumn("list_no", F.lit(2)), allowMissingColumns=True)
    rank = F.when(F.col("status") == "verified", 1000).otherwise(0) + F.col("n") * 10 + F.col("monthly_burden") / 100000
    w = Window.partitionBy("doc_id", F.lower("funder")).orderBy(rank.desc(), "list_no")
    return both.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "list_no")


def stacking(positions: DataFrame, revenue: DataFrame) -> DataFrame:
    """Positions and their burden against revenue (doc_id, revenue); the ratio is null without revenue."""
    g = positions.groupBy("doc_id").agg(F.count("*").cast("long").alias("position_count"), F.sum(F.col("monthly_burden").cast(MONEY)).cast("double").alias("total_burden"))
    g = revenue.join(g, "doc_id", "left").fillna(0, ["position_count", "total_burden"])
    ratio = F.when(F.col("revenue") != 0, round2(F.round(F.col("total_burden") / F.col("revenue"), 6)))
    return g.select("doc_id", "position_count", "total_burden", ratio.alias("burden_ratio"), (F.col("position_count") >= 2).alias("stacked"))


# -- cash flow ----------------------------------------------------------------------------------


def daily_cash_flow(txns: DataFrame) -> DataFrame:
    """Means per active day; every row's date counts, at least one day."""
    amount = F.coalesce(F.col("amount"), F.lit(0).cast(MONEY))
    total = [F.sum(F.when(F.col("direction") == k, amount).otherwise(F.lit(0).cast(MONEY))).alias(k) for k in ("credit", "debit")]
    g = txns.groupBy("doc_id").agg(*total, F.greatest(F.countDistinct("txn_date"), F.lit(1)).cast("long").alias("active_day_count"))
    n = F.col("active_day_count")
    return g.select("doc_id", ratio2(F.col("credit"), n).alias("average_daily_inflow"), ratio2(F.col("debit"), n).alias("average_daily_outflow"), ratio2(F.col("credit") - F.col("debit"), n).alias("net_daily_cash_flow"), "active_day_count")


def daily_balance(txns: DataFrame) -> DataFrame:
    """Figures of the running balances; documents without any have available = false."""
    b = F.col("running_balance")
    below = F.when(b < 0, F.coalesce(F.col("txn_date").cast("string"), F.lit("none")))
    g = txns.groupBy("doc_id").agg(F.count(b).cast("long").alias("sampled_days"), F.sum(b).alias("total"), F.min(b).cast("double").alias("lowest_balance"), F.max(b).cast("double").alias("highest_balance"), F.countDistinct(below).cast("long").alias("negative_day_count"))
    some = F.col("sampled_days") > 0
    return g.select("doc_id", some.alias("available"), F.when(some, ratio2(F.col("total"), F.col("sampled_days"))).alias("average_daily_balance"), "lowest_balance", "highest_balance", "negative_day_count", "sampled_days")


def revenue_trend(series: DataFrame) -> DataFrame:
    """series: doc_id, period, value. increasing, decreasing, irregular, stable or insufficient_data."""
    s = series.where("value is not null")
    d = s.withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("doc_id").orderBy("period")))
    g = d.groupBy("doc_id").agg(F.count("*").cast("long").alias("periods"), F.min("step").alias("low"), F.max("step").alias("high"), F.avg(F.abs("step")).alias("moved"), F.avg("value").alias("mean"))
    volatile = (F.col("mean") > 0) & (F.col("moved") / F.col("mean") > 0.25)
    trend = F.when(F.col("periods") < 2, "insufficient_data").when(F.col("low") > 0, "increasing").when(F.col("high") < 0, "decreasing").when(volatile, "irregular").otherwise("stable")
    return g.select("doc_id", trend.alias("trend"), "periods")


def chain_continuity(statements: DataFrame) -> DataFrame:
    """statements: account, period_end, opening, ending. Whether each opening equals the ending before it; null for the first."""
    before = F.lag("ending").over(Window.partitionBy("account").orderBy("period_end"))
    s = statements.withColumn("previous_ending", before)
    return s.withColumn("continues", F.when(F.col("previous_ending").isNotNull(), F.abs(F.col("opening") - F.col("previous_ending")) <= 0.02))


def reconcile(txns: DataFrame, statements: DataFrame) -> DataFrame:
    """statements: doc_id, opening, ending, verified, eq_beginning, eq_ending, eq_deposits, eq_withdrawals, eq_difference, truncated.

    A proven equation decides, an unproven one with totals leaves it open, then a truncated document or a
    missing balance; else opening + credits - debits must meet the ending within two cents."""
    amount = F.coalesce(F.col("amount"), F.lit(0).cast(MONEY))
    g = txns.groupBy("doc_id").agg(*[F.sum(F.when(F.col("direction") == k, amount).otherwise(F.lit(0).cast(MONEY))).alias(f"total_{k}s") for k in ("credit", "debit")])
    return reconcile_totals(statements.join(g, "doc_id", "left"))


def reconcile_totals(statements: DataFrame) -> DataFrame:
    """reconcile for statements that have total_credits and total_debits already."""
    s = statements.fillna(0, ["total_credits", "total_debits"])
    by_rows = F.col("opening") + F.col("total_credits") - F.col("total_debits")
    proven = F.coalesce("verified", F.lit(False))
    unproven = ~proven & F.col("eq_deposits").isNotNull() & F.col("eq_withdrawals").isNotNull()
    cut = ~proven & ~unproven & F.coalesce("truncated", F.lit(False))
    missing = ~proven & ~unproven & ~cut & (F.col("opening").isNull() | F.col("ending").isNull())
    gap = by_rows - F.col("ending")
    fits = F.abs(gap) <= 0.02
    return s.select(
        "doc_id", F.when(proven, F.lit(True)).when(unproven | cut | missing, F.lit(None).cast("boolean")).otherwise(fits).alias("reconciles"),
        F.when(proven, F.col("eq_ending")).when(unproven, F.col("eq_beginning") + F.col("eq_deposits") - F.col("eq_withdrawals")).when(cut | missing, F.lit(None)).otherwise(by_rows).cast("double").alias("expected_ending"),
        F.when(proven, F.lit(0)).when(unproven, F.col("eq_difference")).when(cut | missing, F.lit(None)).otherwise(gap).cast("double").alias("difference"),
        F.col("total_credits").cast("double").alias("total_credits"), F.col("total_debits").cast("double").alias("total_debits"),
        F.when(proven | unproven, "statement_balance_equation").otherwise("transactions").alias("source"),
        F.when(proven, "ok").when(unproven, "equation_not_provable").when(cut, "statement_truncated").when(missing, "missing_opening_or_ending_balance").when(fits, "ok").otherwise("mismatch").alias("reason"),
    )


def ledger_totals(txns: DataFrame) -> DataFrame:
    """A row per document in one pass over its rows: txn_count, flagged_count (review_flag), gross_deposits, true_revenue, total_credits,
    total_debits, event_count (overdraft events, equal ones once), position_count (funders paid) and position_review_count (those paid once).

    The windows and the grouping have the document as their first key, so rows dealt by document aren't dealt again."""
    amount, c = F.coalesce(F.col("amount"), F.lit(0).cast(MONEY)), F.col
    paid = F.when((c("direction") == "debit") & c("amount").isNotNull(), funder(text()))
    t = txns.withColumns({"event": first_match(L.EVENT_KINDS, text(), F.lit(None).cast("string")), "paid": paid, "deposit": F.when((c("direction") == "credit") & c("amount").isNotNull(), deposit_kind(text()))})
    same, payee = Window.partitionBy("doc_id", "event", "txn_date", "amount").orderBy("txn_no"), Window.partitionBy("doc_id", "paid")
    t = t.withColumns({"event_no": F.row_number().over(same), "paid_no": F.row_number().over(payee.orderBy("txn_no")), "paid_n": F.count("*").over(payee)})
    once = c("paid").isNotNull() & (c("paid_no") == 1)
    return t.groupBy("doc_id").agg(
        F.count("*").cast("long").alias("txn_count"), count_when(c("review_flag")).alias("flagged_count"), amount_when(c("deposit").isNotNull(), c("amount")).alias("gross_deposits"), amount_when(c("deposit") == "revenue", c("amount")).alias("true_revenue"),
        *[F.sum(F.when(c("direction") == k, amount).otherwise(F.lit(0).cast(MONEY))).alias(f"total_{k}s") for k in ("credit", "debit")], count_when(c("event").isNotNull() & (c("event_no") == 1)).alias("event_count"),
        count_when(once).alias("position_count"), count_when(once & (c("paid_n") < 2) & (c("paid") != "DoorDash Capital")).alias("position_review_count"),
    )


# What tells a debit or a credit on a raw line.
LINE_CREDIT_SECTION = r"(?i)(deposits?\s*(?:&|and)?\s*credits?|credits?\s*(?:&|and)?\s*deposits?|deposits/other credits|deposits and other credits)"
LINE_DEBIT_SECTION = r"(?i)(withdrawals?|debits?|checks paid|electronic withdrawals?|other withdrawals?|payments and other debits|withdrawals and other debits|debits and withdrawals)"
LINE_MINUS = r"(?:^|\s)-\s*\$?\s*\d[\d,]*\.\d{2}\b|\(\s*\$?\s*\d[\d,]*\.\d{2}\s*\)"
LINE_INCOMING = r"(?i)\b(?:wire\s+type\s*:\s*wire\s+in|loan\s+proceeds|funding)\b"
LINE_DEBIT = r"(?i)\b(?:ach\s+debit|debit|withdrawal|external\s+withdrawal|e\s+withdrawal|payment|pmt)\b"
LINE_CREDIT = r"(?i)\b(?:deposit|credit|external\s+deposit|e\s+deposit)\b"
LINE_NOISE = [r"(?i)\b(?:DES|ID|TRACE|REF|Transaction)\s*[:#]?\s*[A-Z0-9-]+", r"(?i)(?:\*{2,}|X{2,})\d+", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"]
LINE_MONEY = r"(\$?\s*(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.\d{2})?|[0-9]{4,}(?:\.\d{2})?|[0-9]{1,3}\.\d{2}))"
PER_DOCUMENT = 12


def advance_positions_from_lines(lines: DataFrame) -> DataFrame:
    """The same from clean lines (doc_id, line_no, line): sections carried down, the lines beside as context, the second
    last amount from 1 to 250,000 taken, dates with a placeholder year; a span of 20 days or more counts what was seen,
    a shorter one the rate. At most twelve a document, verified first."""
    line, order = F.col("line"), Window.partitionBy("doc_id").orderBy("line_no")
    kind = F.when(line.rlike(LINE_CREDIT_SECTION), "credit").when(line.rlike(LINE_DEBIT_SECTION), "debit")
    t = lines.withColumns({
        "section": F.last(kind, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "context": F.concat_ws(" ", F.lag("line").over(order), line, F.lead("line").over(order)),
    }).withColumn("funder", funder(line)).where("funder is not null")
    debit = F.when(line.rlike(LINE_MINUS), True).when(F.col("context").rlike(LINE_INCOMING), False).when(line.rlike(LINE_DEBIT), True).when(line.rlike(LINE_CREDIT), False).otherwise(F.coalesce("section", F.lit("")) != "credit")
    scrubbed = functools.reduce(lambda v, p: F.regexp_replace(v, p, " "), LINE_NOISE, line)
    raw = F.filter(F.regexp_extract_all(scrubbed, F.lit(LINE_MONEY)), lambda x: ~x.rlike(r"^\s*\d{7,}$"))
    values = F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"[$,\s]", "").try_cast(MONEY)), lambda v: (v >= 1) & (v <= 250000) & ~v.between(2020, 2030))
    amount = F.when(F.size(values) >= 2, F.get(values, F.size(values) - 2)).otherwise(F.get(values, F.lit(0)))
    part = [F.regexp_extract(line, r"\b(\d{1,2})/(\d{1,2})(?:/\d{2,4})?\b", i).try_cast("int") for i in (1, 2)]
    date = F.to_date(F.try_to_timestamp(F.format_string("2000-%02d-%02d", F.least(F.lit(12), F.greatest(F.lit(1), part[0])), F.least(F.lit(31), F.greatest(F.lit(1), part[1]))), F.lit("yyyy-MM-dd")))
    t = t.where(debit).select("doc_id", "funder", F.col("line_no").alias("txn_no"), "line", amount.alias("amount"), F.when(amount.isNotNull() & part[0].isNotNull(), date).alias("txn_date"))
    keys = ["doc_id", "funder"]
    g = classify_cadence(t, keys).join(typical_amount(t.where("amount is not null"), keys), keys, "left")
    g = g.join(t.groupBy(*keys).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("seen"), F.min_by("line", "txn_no").alias("evidence"), F.min("txn_no").alias("first_no")), keys)
    a = F.coalesce("typical_amount", F.lit(0.0))
    rate = round2(F.round(F.when(F.col("cadence") == "daily", a * 30).when(F.col("cadence") == "weekly", a * 4.33).otherwise(a), 6))
    long = F.coalesce(F.datediff("last_date", "first_date"), F.lit(0)) >= 20
    burden = F.when(long, F.when(F.col("seen") != 0, F.col("seen")).otherwise(rate)).otherwise(F.when(rate != 0, rate).otherwise(F.col("seen")))
    status = F.when((F.col("funder") != L.GENERIC_FUNDER) | (F.col("n") >= 2), "verified").otherwise("needs_review")
    out = g.select("doc_id", "funder", a.alias("typical_amount"), "cadence", "first_date", "last_date", "n", burden.alias("monthly_burden"), status.alias("status"), "evidence", "first_no")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("status"), F.desc("n"), "first_no"))
    return out.withColumn("place", place).where(F.col("place") <= PER_DOCUMENT).drop("place", "first_no")

"""Canonical inputs from the star-schema tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY

# Descriptions of ledger rows; the row's number picks one.
PHRASES = [
    "ACH CREDIT STRIPE PAYOUT 88213", "ONLINE TRANSFER FROM SAVINGS", "PAYROLL ADP 5521", "RENT PROPERTY MGMT", "FORWARD FINANCING ACH DEBIT 7711",
    "MERCHANT DEPOSIT SETTLEMENT", "NSF FEE", "KAPITUS DAILY PMT", "REVERSAL OF RETURNED DEPOSIT", "ONDECK CAPITAL ADVANCE FUNDING", "OVERDRAFT ITEM FEE",
    "CON EDISON UTILITY", "GEICO INSURANCE", "IRS EFTPS TAX PMT", "POS PURCHASE OFFICE SUPPLY", "ATM CASH WITHDRAWAL", "CAPITAL ONE BUSINESS LOAN FUNDING FUNDX",
    "CAPITAL ONE SERVICES FUNDBOX", "DOORDASH CAPITAL REPAYMENT", "CASH ADVANCE PAYMENT MCA", "RETURNED ITEM CHARGEBACK", "WIRE IN CUSTOMER 4432118",
    "CHECK 1042", "UBER EATS CURRENT DEP", "RAPID FINANCE WEEKLY", "SERVICE CHARGE MONTHLY FEE", "XFER BETWEEN ACCOUNTS", "VENDOR ACME SUPPLIES 9921",
]
CREDITS, DEBITS = ("view", "purchase"), ("click", "signup")


def pick(values: list, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def direction(kind: Column) -> Column:
    return F.when(kind.isin(*CREDITS), "credit").when(kind.isin(*DEBITS), "debit").otherwise("needs_review")


def ledger(spark: SparkSession, sf_dir: str, balance: bool = False) -> DataFrame:
    """Ledger rows from events: an account a user, a row an event. With `balance`, the running balance."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("txn_no"), F.to_date("ts").alias("txn_date"),
        pick(PHRASES, F.col("event_id")).alias("description"), F.round("value", 2).cast(MONEY).alias("amount"), direction(F.col("event_type")).alias("direction"),
    )
    if not balance:
        return rows
    signed = F.when(F.col("direction") == "credit", F.col("amount")).when(F.col("direction") == "debit", -F.col("amount")).otherwise(F.lit(0).cast(MONEY))
    order = Window.partitionBy("doc_id").orderBy("txn_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_balance", F.sum(signed).over(order).cast(MONEY))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(x) for x in values) + "]"


LEDGER_SQL = f"""ledger AS (
  SELECT user_id AS doc_id, event_id AS txn_no, CAST(ts AS DATE) AS txn_date, {sql_list(PHRASES)}[CAST(event_id % {len(PHRASES)} AS BIGINT) + 1] AS description,
    CAST(round(value, 2) AS DECIMAL(18,2)) AS amount,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'credit' WHEN event_type IN ('click', 'signup') THEN 'debit' ELSE 'needs_review' END AS direction
  FROM events),
balanced AS (
  SELECT *, sum(CASE direction WHEN 'credit' THEN amount WHEN 'debit' THEN -amount ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY txn_no) AS running_balance FROM ledger)"""


def big_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows from lineitem and orders: an account a customer, a document an account and year."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    return rows.select(
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("l_shipdate").cast("string")).alias("doc_id"), F.col("o_custkey").alias("account"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("txn_no"), F.to_date("l_shipdate").alias("txn_date"), pick(PHRASES, F.col("l_partkey")).alias("description"),
        F.round("l_extendedprice", 2).cast(MONEY).alias("amount"), F.when(F.col("l_returnflag") == "N", "credit").when(F.col("l_returnflag") == "A", "debit").otherwise("needs_review").alias("direction"),
    )


BIG_LEDGER_SQL = f"""ledger AS (
  SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR) AS doc_id, o_custkey AS account, l_orderkey * 8 + l_linenumber AS txn_no, CAST(l_shipdate AS DATE) AS txn_date,
    {sql_list(PHRASES)}[CAST(l_partkey % {len(PHRASES)} AS BIGINT) + 1] AS description, CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS amount,
    CASE l_returnflag WHEN 'N' THEN 'credit' WHEN 'A' THEN 'debit' ELSE 'needs_review' END AS direction
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# Heads of document texts; the document's number picks one, the document's own text stands below.
HEADS = [
    "Account Statement\nStatement Period 01/05/2026 - 01/31/2026\nWells Fargo Business\nBeginning balance $1,200.00\nEnding balance $1,450.10\nAccount Number: 1234-5678-9012",
    "Legal Business Name: Blue River Foods Inc\nBusiness Owner Information\nOwner Name: Ann B. Lee\nDate of Birth: 02/03/1975\nFederal Tax ID: 12-3456789\nSSN: 123-45-6789\nAverage Monthly Revenue: $125,000\nCell (212) 555-0101 ann@blueriver.com",
    "Mobile\n(212) 555-0199\nEmail\nsam@shop.org\n(312) 555-0142",
    "TD Bank Account summary\nDaily balance\nDeposits and other credits\nStatement ending 03/31/2026 month to date\nAccount ending XXXX4821",
    "Company name Acme Tools LLC\nBusiness Start Date\nJanuary 5 2011\nGross annual revenue 1,200,000\nUse of funds stock\nOwner details\nphone 415.555.0177",
    "",
    "KeyBank letter\nThe amount of 4,120.55 was paid (312) 555-0188 to info@example.org",
]
FILENAMES = ["Acme Tools LLC 02_11_2026/stmt jan 2026.pdf", "Blue River Foods/Blue_River-Foods application.pdf", "contacts.pdf", "Zed Co_03-04-26/2026-03-31 statement mtd.pdf", "scan.pdf", "", "box/letters/KeyBank 2026-02.pdf"]
NAMES = ["1950'S Original", "1950 ORIGINALS LLC", "984, LLC", "984", "G&S Metal Products INC", "Test Company LLC", "acme tools", "ACME TOOLS, INC.", "The Boss Services Ltd", "Blue  River Foods", "LLC", ""]
STREETS = ["1201 Richardson Drive, Richardson, TX 75080", "1201 RICHARDSON DR STE 180, RICHARDSON, TX 75080-4610", "12 Main St, Austin TX", "12b Main St, Austin, TX 78753", "PO Box 9, Reno NV 89501", "no place"]
AMOUNTS = ["$1,234.56", "(1,234.56)", "-1,234.56", "1,234.56-", "", "12.5", "$ 7"]


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, raw_text, source from documents."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select("doc_id", pick(FILENAMES, n).alias("filename"), F.concat(pick(HEADS, n), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("raw_text"), "source", "text")


def sql_pick(values: list[str], number: str) -> str:
    return f"{sql_list(values)}[CAST(({number}) % {len(values)} AS BIGINT) + 1]"


DOCS_SQL = f"""docs AS (SELECT doc_id, {sql_pick(FILENAMES, 'doc_id')} AS filename, {sql_pick(HEADS, 'doc_id')} || chr(10) || coalesce(text, '') AS raw_text, source, text FROM documents),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line FROM (SELECT doc_id, i, trim(regexp_replace(replace(x, chr(160), ' '), '\\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM docs)) WHERE line <> '')"""


# Heads of statements in the layouts that the rules for banks, holders and accounts tell apart; the document's own text stands below.
_FILLER = "\n".join(f"row {i} of the notice" for i in range(40))
STATEMENTS = [
    "Wells Fargo Everyday Business\nACECMKMEIGOCICAAMGOAGCMK BLUE RIVER FOODS LLC\n019749 808 BANKS AVE reserve your seat\nCLEVELAND OH 44127-1831 Online: wellsfargo.com\nAccount number: 1234567890\nBeginning balance $8,059.65",
    _FILLER + "\nOld National branch\n$1,200.00 (45.10)\n12345678 2026 3,000,000.00-",
    _FILLER + "\nsee htb.com and visionsfcu.org\nAccount No. 900-11-2233",
    _FILLER + "\nnano something ban\nxxxx - 5521",
    "Truist letter\nAccount Holder: Ann Lee Design Studio\nd/b/a Lee Studio,\nAccount Number\nPage 1 of 3\n000123456789\nPrepared for: Statement desk",
    "Indiana imcu.com\nABBASPOUR INC IMCU now offers Visa cards.\n12 Main St Apt 4\nAustin, TX 78753\nchecking account ending *4821-77",
    "MICRO BUSINESS DRAFT\nMember #:\nnone\n445566\nApr 14, 2026 THORO CORP\nDoing Business As: Corner Shop",
    "Accounts Summary\nAccount number\nBusiness Checking\n55443322\nP.O. Box 77 Holdings LLC\n366 Metro Mart INC\nsuite 4\nPO BOX 1234\nReno NV 89501-4610",
    "0012345678\nstatement of account\nAccount Summary Account #\n04-13-2026 ZEL FROM AL MAWA LLC\nESTAFFLLC4812 ESTAFF LLC;\n2998 SCOTT BLVD STE 180 call (408) 731-4197 or\nSanta Clara CA 95054",
    "To whom it may concern\n98 7654 3210 12\nTruist Holdings LLC\nJPMorgan Chase Bank NA",
    "Business Name - 984 LLC\nP.O. BOX 9\n12 Side Road NW unit 7b\nDaly City, CA 94015\nuse ** 4455 below",
    "",
    "KeyPoint desk\nChase Business\nCustomer Name: Keypoint Credit Union\nGold Coast Partners\nfloor 2",
]
STATEMENT_FILES = ["a.pdf", "cnb march.pdf", "Old National 2026.pdf", "farmers/stmt.pdf", "scan.pdf", "b/2026-02.pdf", "stmt.pdf"]


def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename and raw_text of every document."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select("doc_id", pick(STATEMENT_FILES, F.floor(n / len(STATEMENTS))).alias("filename"), F.concat(pick(STATEMENTS, n), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("raw_text"))


STATEMENTS_SQL = f"""docs AS (SELECT doc_id, {sql_pick(STATEMENT_FILES, f'doc_id // {len(STATEMENTS)}')} AS filename, {sql_pick(STATEMENTS, 'doc_id')} || chr(10) || coalesce(text, '') AS raw_text FROM documents),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line FROM (SELECT doc_id, i, trim(regexp_replace(replace(x, chr(160), ' '), '\\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM docs)) WHERE line <> '')"""


KINDS = ["application", "bank_statement", "bank_statement", "unknown", "bank_statement"]
STATUSES = ["complete", "needs_review", "complete", "queued", "failed", "complete", "ocr", "stopped", "skipped", "complete", "complete"]
LEVELS = ["high", "medium", "low", "needs_review"]
BANKS = ["Chase", "Wells Fargo", "TD Bank"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document facts from customer: six customers make a company, each in another spelling; every third company has a folder."""
    k = F.col("c_custkey")
    company_no = F.floor(k / 6).cast("long")
    number = company_no.cast("string")
    name = F.when(k % 6 == 1, F.concat(F.lit("ACME "), number, F.lit(" TRADERS, INC."))).when(k % 6 == 2, F.concat(F.lit("acme "), number, F.lit(" trader"))).when(k % 6 == 5, F.lit(None)).otherwise(F.concat(F.lit("Acme "), number, F.lit(" Traders LLC")))
    kind = pick(KINDS, k)
    app = kind == "application"
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), k.alias("arrival_no"), F.when(company_no % 3 == 0, F.concat(F.lit("Acme "), number, F.lit(" Traders LLC 02_11_2026/"), k.cast("string"), F.lit(".pdf"))).otherwise(F.concat(k.cast("string"), F.lit(".pdf"))).alias("filename"),
        kind.alias("doc_type"), (k % 11 == 0).alias("is_mtd"), pick(STATUSES, k).alias("status"), F.when(k % 13 == 12, k - 1).alias("duplicate_of"), name.alias("company"), F.when(app & (k % 2 == 0), F.concat(F.lit("Owner "), number)).alias("owner"),
        F.concat(number, F.lit(" Main St, Austin, TX 78753")).alias("address"), pick(["2026-01-31", "2026-02-28", "2026-03-31", None], k).alias("period_end"), F.lit(None).cast("string").alias("period_start"),
        F.when(kind == "bank_statement", F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("reconciles"), F.when(kind == "bank_statement", F.abs(F.round(balance, 2)) * (k % 2)).alias("true_revenue"), F.when(kind == "bank_statement", F.abs(F.round(balance, 2)) + 100).alias("total_deposits"),
        F.when(app & (balance > 3000), F.floor(balance)).cast("double").alias("stated_revenue"), F.when(~app & (k % 7 != 0), (k % 5)).alias("points"), pick(LEVELS, k).alias("level"), F.when(app, k % 9).alias("fields_found"), (k % 4).alias("review_count"),
        F.when(k % 4 != 0, pick(BANKS, k)).alias("bank"), F.lpad((k * 7919).cast("string"), 10, "0").alias("account"), F.when(app & (k % 10 == 5), "contact_sheet").alias("kind"), (k % 3 == 0).alias("used_ocr"), (k % 5 != 0).alias("text_trusted"), ((k % 10) / 20.0).alias("review_ratio"), (k % 17 == 0).alias("truncated"),
    )


FACTS_SQL = f"""facts AS (SELECT *, CASE WHEN doc_type = 'bank_statement' THEN CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS reconciles, CASE WHEN doc_type = 'bank_statement' THEN abs(round(balance, 2)) * (doc_id % 2) END AS true_revenue,
 CASE WHEN doc_type = 'bank_statement' THEN abs(round(balance, 2)) + 100 END AS total_deposits, CASE WHEN doc_type = 'application' AND balance > 3000 THEN CAST(floor(balance) AS DOUBLE) END AS stated_revenue, CASE WHEN doc_type <> 'application' AND doc_id % 7 <> 0 THEN doc_id % 5 END AS points,
 CASE WHEN doc_type = 'application' THEN doc_id % 9 END AS fields_found, doc_id % 4 AS review_count, CASE WHEN doc_type = 'application' AND doc_id % 2 = 0 THEN 'Owner ' || company_no END AS owner, CASE WHEN doc_type = 'application' AND doc_id % 10 = 5 THEN 'contact_sheet' END AS kind FROM (
 SELECT c_custkey AS doc_id, c_custkey AS arrival_no, CAST(floor(c_custkey / 6) AS BIGINT) AS company_no, CASE WHEN CAST(floor(c_custkey / 6) AS BIGINT) % 3 = 0 THEN 'Acme ' || CAST(floor(c_custkey / 6) AS BIGINT) || ' Traders LLC 02_11_2026/' || c_custkey || '.pdf' ELSE c_custkey || '.pdf' END AS filename,
 {sql_pick(KINDS, 'c_custkey')} AS doc_type, c_custkey % 11 = 0 AS is_mtd, {sql_pick(STATUSES, 'c_custkey')} AS status, CASE WHEN c_custkey % 13 = 12 THEN c_custkey - 1 END AS duplicate_of,
 CASE c_custkey % 6 WHEN 1 THEN 'ACME ' || CAST(floor(c_custkey / 6) AS BIGINT) || ' TRADERS, INC.' WHEN 2 THEN 'acme ' || CAST(floor(c_custkey / 6) AS BIGINT) || ' trader' WHEN 5 THEN NULL ELSE 'Acme ' || CAST(floor(c_custkey / 6) AS BIGINT) || ' Traders LLC' END AS company,
 ['2026-01-31', '2026-02-28', '2026-03-31', NULL][CAST(c_custkey % 4 AS BIGINT) + 1] AS period_end, {sql_pick(LEVELS, 'c_custkey')} AS level, CASE WHEN c_custkey % 4 <> 0 THEN {sql_pick(BANKS, 'c_custkey')} END AS bank, c_acctbal AS balance, lpad(CAST(c_custkey * 7919 AS VARCHAR), 10, '0') AS account,
 c_custkey % 3 = 0 AS used_ocr, c_custkey % 5 <> 0 AS text_trusted, (c_custkey % 10) / 20.0 AS review_ratio, c_custkey % 17 = 0 AS truncated FROM customer))"""

"""Queries over document facts derived from customer: verdicts, companies, leads and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import leads as G
from ..operators import verdicts as V
from ..sources import bridge as B
from ..sources.store import kept
from .text_queries import period_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "", base: str = B.FACTS_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {base}\n{sql}"
        return f

    return add


SCORE = """CASE WHEN doc_type = 'application' THEN floor(coalesce(fields_found, 0) * 100 / 8 + 0.5) WHEN points IS NOT NULL THEN floor(points * 100 / 4 + 0.5)
 ELSE CASE level WHEN 'high' THEN 100 WHEN 'medium' THEN 75 WHEN 'low' THEN 50 WHEN 'needs_review' THEN 35 ELSE 0 END END"""
REVENUE = "coalesce(stated_revenue, CASE WHEN true_revenue > 0 THEN true_revenue ELSE total_deposits END, 0)"
VERIFIED = "CASE WHEN reconciles THEN 'verified' WHEN NOT reconciles THEN 'conflicting' ELSE 'unverified' END"
STATUS_RANK = "CASE status WHEN 'failed' THEN 5 WHEN 'needs_review' THEN 4 WHEN 'stopped' THEN 3 WHEN 'ocr' THEN 2 WHEN 'queued' THEN 1 ELSE 0 END"
# The spellings of one company share the key "acme <no> trader"; a document without a name stands alone unless its folder has one.
KEY = "CASE WHEN company_no % 3 = 0 OR company IS NOT NULL THEN 'acme ' || company_no || ' trader' ELSE 'unassociated:' || doc_id END"


@query(f"SELECT doc_id, CAST({SCORE} AS BIGINT) AS score, {VERIFIED} AS verification, CAST({REVENUE} AS DOUBLE) AS revenue FROM facts")
def extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.facts(spark, sf_dir).select("doc_id", V.extraction_score().alias("score"), V.revenue_verification().alias("verification"), V.document_revenue().alias("revenue"))


@query("""SELECT doc_id, p AS points, CASE WHEN reconciles = false THEN 'needs_review' WHEN p = 4 AND review_ratio <= 0.1 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS level,
 array_to_string(list_filter([CASE WHEN bank IS NULL THEN 'bank_not_recognized' END, CASE WHEN NOT text_trusted THEN 'low_text_quality' END, CASE WHEN used_ocr THEN 'required_ocr_fallback' END,
 CASE WHEN reconciles = false THEN 'reconciliation_mismatch' WHEN reconciles IS NULL THEN 'reconciliation_not_possible' END, CASE WHEN review_ratio > 0.35 THEN 'high_unparsed_line_ratio' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (
 SELECT *, CAST(bank IS NOT NULL AS INT) + CAST(text_trusted AS INT) + CAST(NOT used_ocr AS INT) + CAST(coalesce(reconciles, false) AS INT) AS p FROM facts)""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confidence(B.facts(spark, sf_dir)).select("doc_id", "points", "level", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT doc_id, CASE WHEN source IS NULL THEN 'missing' WHEN starts_with(source, 'document_text') THEN 'high' WHEN starts_with(source, 'filename') THEN 'low' ELSE 'medium' END AS confidence FROM ({period_sql()})", B.DOCS_SQL)
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each text's statement period is, by where it was read."""
    d = B.document_texts(spark, sf_dir)
    return d.select("doc_id", V.field_confidence(T.statement_period(F.col("raw_text"), F.col("filename"), 2026)["source"]).alias("confidence"))


@query("""SELECT doc_id, CASE WHEN doc_type = 'unknown' AND (doc_id % 2 > 0 OR coalesce(reconciles, false)) THEN 'bank_statement' ELSE doc_type END AS doc_type, CASE WHEN review_count > 0 THEN 'needs_review' ELSE 'complete' END AS status FROM facts""")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.facts(spark, sf_dir).withColumn("txn_count", F.col("doc_id") % 2)
    return V.final_type_and_status(f).select("doc_id", "doc_type", "status")


GAPS = """list_filter([CASE WHEN reconciles IS NULL THEN 'balances not proven' END, CASE WHEN reconciles = false THEN 'balances do not add up' END, CASE WHEN bank IS NULL THEN 'bank unknown' END, CASE WHEN period_end IS NULL THEN 'no period' END], lambda x: x IS NOT NULL)"""


DIAGNOSES = f"""SELECT doc_id, CASE WHEN status IN ('queued', 'validating', 'extracting', 'ocr') THEN 'pending' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN status = 'skipped' THEN 'excluded' WHEN status = 'failed' THEN 'bad' WHEN status = 'stopped' THEN 'stopped'
 WHEN doc_type = 'application' THEN CASE WHEN coalesce(fields_found, 0) >= 6 THEN 'good' WHEN coalesce(fields_found, 0) >= 3 THEN 'partial' ELSE 'bad' END
 WHEN doc_type = 'bank_statement' THEN CASE WHEN len({GAPS}) = 0 THEN 'good' WHEN len({GAPS}) <= 2 THEN 'partial' ELSE 'bad' END ELSE 'bad' END AS verdict,
 CASE doc_type WHEN 'application' THEN CASE WHEN coalesce(fields_found, 0) < 8 THEN CAST(8 - coalesce(fields_found, 0) AS VARCHAR) || ' fields missing' ELSE '' END WHEN 'bank_statement' THEN array_to_string({GAPS}, '; ') ELSE 'not recognised' END AS gaps FROM facts"""


@query(DIAGNOSES)
def diagnose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.diagnose_documents(B.facts(spark, sf_dir))


@query(f""", v AS ({DIAGNOSES}) SELECT verdict, count(*) AS documents FROM v GROUP BY 1""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.diagnose_documents(B.facts(spark, sf_dir)).groupBy("verdict").agg(F.count("*").cast("long").alias("documents"))


POSITIONS = """positions AS (SELECT user_id AS doc_id, CASE user_id % 3 WHEN 0 THEN 'Kapitus' WHEN 1 THEN 'OnDeck' ELSE 'FundX' END AS funder, count(*) AS n, round(sum(value), 2) AS monthly_burden, CASE WHEN count(*) % 2 = 0 THEN 'verified' ELSE 'needs_review' END AS status FROM events GROUP BY 1, 2)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").alias("doc_id"), B.pick(["Kapitus", "OnDeck", "FundX"], F.col("user_id")).alias("funder"))
    return g.agg(F.count("*").cast("long").alias("n"), F.round(F.sum("value"), 2).alias("monthly_burden")).withColumn("status", F.when(F.col("n") % 2 == 0, "verified").otherwise("needs_review"))


ITEMS = f"""{B.LEDGER_SQL.replace('ledger AS', 'ledger AS', 1)}, {POSITIONS}"""


@query(f""", {ITEMS} SELECT doc_id, unnest(list_filter([CASE WHEN used_ocr THEN 'needs_ocr' END, CASE WHEN bank IS NULL THEN 'unknown_bank' END, CASE WHEN truncated THEN 'statement_truncated' END, CASE WHEN reconciles = false THEN 'reconciliation_mismatch' END, CASE WHEN NOT text_trusted THEN 'low_text_quality' END], lambda x: x IS NOT NULL)) AS type, NULL AS detail FROM facts
 UNION ALL SELECT doc_id, 'transaction_review', CAST(txn_no AS VARCHAR) FROM ledger WHERE amount IS NULL OR direction = 'needs_review' UNION ALL SELECT doc_id, 'advance_review', funder FROM positions WHERE status = 'needs_review'""")
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.facts(spark, sf_dir).withColumn("needs_ocr", F.col("used_ocr"))
    return V.review_items(f, B.ledger(spark, sf_dir), _positions(spark, sf_dir))


@query(f""", {ITEMS} SELECT doc_id, CASE WHEN amount IS NULL THEN 'amount_unparsed' ELSE 'direction_unclear' END AS reason, CAST(txn_no AS VARCHAR) AS detail FROM ledger WHERE amount IS NULL OR direction = 'needs_review'
 UNION ALL SELECT doc_id, 'reconciliation_mismatch', NULL FROM facts WHERE reconciles = false UNION ALL SELECT doc_id, 'unknown_bank', NULL FROM facts WHERE bank IS NULL UNION ALL SELECT doc_id, 'advance_unproven', funder FROM positions WHERE status = 'needs_review'""")
def reviewable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reviewable_items(B.facts(spark, sf_dir), B.ledger(spark, sf_dir), _positions(spark, sf_dir))


@query(f""", {ITEMS} SELECT type, count(*) AS items FROM ({ORACLE_SQL['review_items'].split(POSITIONS, 1)[1]}) GROUP BY 1""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_items(spark, sf_dir).groupBy("type").agg(F.count("*").cast("long").alias("items"))


@query("""SELECT doc_id, txn_no, CASE WHEN direction = 'needs_review' THEN CASE WHEN txn_no % 2 = 0 THEN 'credit' ELSE 'debit' END ELSE direction END AS direction, CAST(CASE WHEN txn_no % 10 = 0 THEN 7.25 ELSE amount END AS DOUBLE) AS amount,
 direction = 'needs_review' OR txn_no % 10 = 0 AS corrected FROM ledger""", B.LEDGER_SQL)
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each uncertain row gets a direction twice (the second wins), every tenth row an amount."""
    t = B.ledger(spark, sf_dir)
    unsure = t.where("direction = 'needs_review'").select("doc_id", "txn_no", F.lit("direction").alias("field"), F.when(F.col("txn_no") % 2 == 0, "credit").otherwise("debit").alias("value"), F.lit(2).alias("corrected_no"))
    first = unsure.withColumns({"value": F.lit("debit"), "corrected_no": F.lit(1)})
    amounts = t.where("txn_no % 10 = 0").select("doc_id", "txn_no", F.lit("amount").alias("field"), F.lit("7.25").alias("value"), F.lit(1).alias("corrected_no"))
    out = V.apply_corrections(t, unsure.unionByName(first).unionByName(amounts))
    return out.select("doc_id", "txn_no", "direction", F.col("amount").cast("double").alias("amount"), "corrected")


@query("""SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text), n_chars ORDER BY doc_id) AS first FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, doc_id FROM documents WHERE text IS NULL)""", "unused AS (SELECT 1)")
def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.col("n_chars").alias("file_size"), F.col("doc_id").alias("arrival_no"))
    return G.mark_duplicates(d).select("doc_id", "duplicate_of")


LEVEL_RANK = "CASE level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END"
OWN_KEY = "CASE WHEN company IS NULL THEN 'unassociated' ELSE 'acme ' || company_no || ' trader' END"
BUCKETS = f"""b AS (SELECT *, {OWN_KEY} AS company_key, CASE WHEN doc_type = 'application' THEN 'application' WHEN is_mtd THEN 'mtd' WHEN doc_type = 'bank_statement' THEN 'statement' ELSE 'unknown' END AS bucket FROM facts),
p AS (SELECT *, row_number() OVER (PARTITION BY company_key, bucket, CASE WHEN bucket = 'statement' THEN period_end ELSE CAST(doc_id AS VARCHAR) END ORDER BY {LEVEL_RANK} DESC, arrival_no) AS place FROM b)"""


@query(f", {BUCKETS} SELECT company_key, first_value(company) OVER (PARTITION BY company_key ORDER BY arrival_no) AS name, bucket, doc_id FROM (SELECT *, bucket <> 'statement' OR place = 1 AS good FROM p) WHERE good".replace("SELECT company_key, first_value(company) OVER (PARTITION BY company_key ORDER BY arrival_no) AS name, bucket, doc_id FROM (SELECT *, bucket", "SELECT company_key, name, bucket, doc_id FROM (SELECT *, first_value(company) OVER (PARTITION BY company_key ORDER BY arrival_no) AS name, bucket"))
def aggregate_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.aggregate_by_company(B.facts(spark, sf_dir)).select("company_key", "name", "bucket", "doc_id")


@query(f"""SELECT doc_id, {KEY} AS lead_id FROM facts""")
def lead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lead_keys(B.facts(spark, sf_dir)).select("doc_id", "lead_id")


@query("""SELECT DISTINCT split_part(filename, '/', 1) AS folder, 'Acme ' || company_no || ' Traders LLC' AS folder_company FROM facts WHERE company_no % 3 = 0""")
def company_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.company_folders(B.facts(spark, sf_dir))


# Documents of a company share its address: a lone statement group joins the lone application group there.
MERGED = f"""keyed AS (SELECT *, {KEY} AS lead0, doc_type = 'bank_statement' AND duplicate_of IS NULL AND NOT is_mtd AS real FROM facts),
sides AS (SELECT lead0, company_no, bool_or(real) AS s, bool_or(doc_type = 'application') AS a, min(arrival_no) AS first FROM keyed GROUP BY 1, 2),
homes AS (SELECT company_no, min_by(lead0, first) AS home FROM sides WHERE a AND NOT s GROUP BY 1),
merged AS (SELECT k.*, CASE WHEN s AND NOT a AND home IS NOT NULL THEN home ELSE k.lead0 END AS lead_id FROM keyed k JOIN sides USING (lead0, company_no) LEFT JOIN homes USING (company_no))"""


@query(f", {MERGED} SELECT doc_id, lead_id FROM merged")
def merge_same_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir))).select("doc_id", "lead_id")


RANK_SQL = "duplicate_of IS NULL DESC, CASE WHEN duplicate_of IS NULL THEN CASE WHEN kind = 'contact_sheet' THEN 0 ELSE 100 END + coalesce(fields_found, 0) ELSE 0 END DESC, arrival_no"
LEADS = f"""{MERGED}, scored AS (SELECT *, CAST({SCORE} AS BIGINT) AS score, CAST({REVENUE} AS DOUBLE) AS rev, {VERIFIED} AS ver, duplicate_of IS NULL AS uniq FROM merged),
apps AS (SELECT lead_id, company, owner, stated_revenue, score, row_number() OVER (PARTITION BY lead_id ORDER BY uniq DESC, CASE WHEN NOT uniq THEN 0 WHEN kind = 'contact_sheet' THEN 0 ELSE 100 + 0 END + CASE WHEN uniq THEN coalesce(fields_found, 0) ELSE 0 END DESC, arrival_no) AS p FROM scored WHERE doc_type = 'application'),
g AS (SELECT lead_id, min_by(company, arrival_no) FILTER (company IS NOT NULL) AS named, min_by(coalesce(company, '~'), arrival_no) AS first_company, min_by('Acme ' || company_no || ' Traders LLC', arrival_no) FILTER (company_no % 3 = 0) AS folder_company, count(*) FILTER (uniq AND doc_type = 'bank_statement' AND NOT is_mtd) AS statement_count,
 count(*) FILTER (uniq AND doc_type = 'bank_statement' AND NOT is_mtd AND ver = 'verified') AS verified_count, avg(rev) FILTER (uniq AND doc_type = 'bank_statement' AND NOT is_mtd AND ver = 'verified' AND rev > 0) AS vm, avg(rev) FILTER (uniq AND doc_type = 'bank_statement' AND NOT is_mtd AND rev > 0) AS pm,
 avg(score) FILTER (uniq AND doc_type = 'bank_statement') AS ss, max_by(status, CAST({STATUS_RANK} AS BIGINT) * 1000000000 - arrival_no) AS status, count(*) FILTER (NOT uniq) AS duplicate_count, CAST(sum(review_count) AS BIGINT) AS issue_count, count(*) AS doc_count FROM scored GROUP BY 1),
leads AS (SELECT g.lead_id, coalesce(CASE WHEN folder_company IS NOT NULL THEN coalesce(a.company, g.named, folder_company) WHEN a.lead_id IS NOT NULL THEN a.company ELSE nullif(g.first_company, '~') END, 'Unassociated') AS company_name, a.owner AS owner_name, coalesce(a.stated_revenue, floor(CASE WHEN verified_count > 0 THEN vm ELSE pm END * 100 + 0.5) / 100, 0) AS revenue,
 CASE WHEN a.stated_revenue IS NOT NULL THEN 'application' WHEN (CASE WHEN verified_count > 0 THEN vm ELSE pm END) IS NULL THEN 'none' WHEN verified_count > 0 THEN 'verified_statements' ELSE 'unverified_statements' END AS revenue_source,
 CAST(CASE WHEN ss IS NULL AND a.score IS NULL THEN 0 WHEN ss IS NULL THEN floor(CAST(a.score AS DOUBLE) * CAST(0.3 AS DOUBLE) + 0.5) WHEN a.score IS NULL THEN floor(ss * CAST(0.85 AS DOUBLE) + 0.5) ELSE floor(ss * CAST(0.7 AS DOUBLE) + CAST(a.score AS DOUBLE) * CAST(0.3 AS DOUBLE) + 0.5) END AS BIGINT) AS score,
 g.status, a.lead_id IS NOT NULL AS has_application, statement_count, duplicate_count, issue_count, doc_count FROM g LEFT JOIN apps a ON a.lead_id = g.lead_id AND a.p = 1)"""


@query(f", {LEADS} SELECT * FROM leads")
def build_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_leads(B.facts(spark, sf_dir))


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lead_facts(G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir))))


AMOUNT = "CASE WHEN revenue < 0 THEN floor(revenue + 0.5) WHEN revenue >= 50000 THEN ceil(revenue / 50000) * 50000 ELSE ceil(revenue / 500) * 500 END"


def _cells(keyed: DataFrame) -> DataFrame:
    """Documents with what the sheets read: contacts in two spellings, dates of forms, ending balances."""
    n, number = F.col("doc_id"), F.floor(F.col("doc_id") / 6).cast("long")
    app = F.col("doc_type") == "application"
    mail = F.concat(F.lit("u"), (n % 3).cast("string"), F.lit("@x.org"))
    day = F.lpad((n % 9 + 1).cast("string"), 2, "0")
    return keyed.withColumns({
        "phones": F.when(app, F.array((n % 4 + 2125550000).cast("string"), F.lit(" "), (number + 2125550000).cast("string"))), "emails": F.when(app & (n % 4 != 0), F.array(F.when(n % 2 == 0, F.upper(mail)).otherwise(mail))),
        "app_date": F.when(app & (n % 2 == 0), F.concat(F.lit("01/"), day, F.lit("/2026"))), "start_date": F.when(app & (n % 3 != 1), F.concat(F.lit("02/"), day, F.lit("/2011"))), "ending": F.when(n % 3 != 0, n * 1.5),
    })


CELLS = f"""cell AS (SELECT *, company_no || ' Main St, Austin, TX 78753' AS address, CASE WHEN doc_type = 'application' THEN [CAST(doc_id % 4 + 2125550000 AS VARCHAR), CAST(company_no + 2125550000 AS VARCHAR)] END AS phones, CASE WHEN doc_type = 'application' AND doc_id % 4 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'U' || doc_id % 3 || '@X.ORG' ELSE 'u' || doc_id % 3 || '@x.org' END END AS email,
 CASE WHEN doc_type = 'application' AND doc_id % 2 = 0 THEN '01/0' || (doc_id % 9 + 1) || '/2026' END AS app_date, CASE WHEN doc_type = 'application' AND doc_id % 3 <> 1 THEN '02/0' || (doc_id % 9 + 1) || '/2011' END AS start_date, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 1.5 END AS ending FROM merged),
real_docs AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY coalesce(period_end, '') DESC, arrival_no) AS spot FROM cell WHERE doc_type = 'bank_statement' AND duplicate_of IS NULL AND NOT is_mtd),
entries AS (SELECT lead_id, doc_id, row_number() OVER (PARTITION BY lead_id ORDER BY spot) AS place, coalesce(period_end, filename) || ' • ' || coalesce(regexp_replace(CAST(CAST(coalesce(true_revenue, total_deposits) AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', ''), '—') || ' • ' || coalesce(regexp_replace(CAST(CAST(ending AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', ''), '—') || ' • ' || CASE WHEN reconciles THEN 'balances add up' WHEN NOT reconciles THEN 'does not add up' ELSE 'not proven' END AS entry FROM real_docs WHERE status IN ('complete', 'needs_review'))"""


@query(f""", {LEADS}, {POSITIONS}, {CELLS},
stm AS (SELECT lead_id, string_agg(entry, ' · ' ORDER BY place) AS statements FROM entries GROUP BY 1),
bnk AS (SELECT lead_id, string_agg(entry, ' · ' ORDER BY spot) AS bank FROM (SELECT lead_id, bank || ' • ' || account AS entry, min(spot) AS spot FROM real_docs WHERE bank IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
mca AS (SELECT lead_id, string_agg(funder || ' • $' || burden || '/mo', ' · ' ORDER BY spot, funder) AS mca FROM (SELECT lead_id, funder, min(spot) AS spot, CAST(floor(CAST(sum(CAST(monthly_burden AS DECIMAL(18,2))) AS DOUBLE) + 0.5) AS BIGINT) AS burden FROM positions p JOIN real_docs r ON r.doc_id = p.doc_id GROUP BY 1, 2) GROUP BY 1),
forms AS (SELECT *, bool_or(duplicate_of IS NULL) OVER w AS any_unique, min(arrival_no) OVER w AS first_no FROM cell WHERE doc_type = 'application' WINDOW w AS (PARTITION BY lead_id)),
good AS (SELECT * FROM forms WHERE CASE WHEN any_unique THEN duplicate_of IS NULL ELSE arrival_no = first_no END),
phone_rows AS (SELECT lead_id, v, min(arrival_no * 10 + i) AS o FROM (SELECT lead_id, arrival_no, unnest(phones) AS v, generate_subscripts(phones, 1) AS i FROM good) GROUP BY 1, 2),
tel AS (SELECT lead_id, string_agg(v, ' • ' ORDER BY o) AS phone FROM phone_rows GROUP BY 1),
mail AS (SELECT lead_id, string_agg(v, ' • ' ORDER BY o) AS email FROM (SELECT lead_id, lower(email) AS same, min_by(email, arrival_no) AS v, min(arrival_no) AS o FROM good WHERE email IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
best AS (SELECT lead_id, address, app_date, start_date FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY {RANK_SQL}) AS p FROM cell WHERE doc_type = 'application') WHERE p = 1),
home AS (SELECT lead_id, min_by(address, arrival_no) AS stated FROM cell WHERE doc_type = 'bank_statement' GROUP BY 1)
SELECT lead_id, company_name AS company, owner_name AS owner, {AMOUNT} AS revenue, {AMOUNT} + 150000 AS approval, phone, email, coalesce(address, stated) AS address, app_date, statements, bank, start_date AS bsd, mca, score, status, CASE WHEN duplicate_count > 0 THEN duplicate_count END AS duplicates_excluded,
 CASE revenue_source WHEN 'application' THEN 'Application' WHEN 'verified_statements' THEN 'Statements (balances add up)' WHEN 'unverified_statements' THEN 'Statements (NOT proven)' END AS revenue_source
 FROM leads LEFT JOIN stm USING (lead_id) LEFT JOIN bnk USING (lead_id) LEFT JOIN mca USING (lead_id) LEFT JOIN tel USING (lead_id) LEFT JOIN mail USING (lead_id) LEFT JOIN best USING (lead_id) LEFT JOIN home USING (lead_id) WHERE company_name <> 'Unassociated'""")
def results_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = kept(_cells(G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir)))))  # read by each list
    return G.results_sheet(G.lead_facts(keyed), keyed, _positions(spark, sf_dir))


@query(f", {MERGED}, {CELLS} SELECT lead_id, place, doc_id, entry FROM entries WHERE place <= 6")
def newest_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six newest statements that a lead's row shows."""
    return G.newest_statements(_cells(G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir)))), 6)


@query(f""", {ITEMS}, {MERGED}, items AS ({ORACLE_SQL['review_items'].split(POSITIONS, 1)[1]}),
placed AS (SELECT m.lead_id, i.doc_id, i.type, row_number() OVER (PARTITION BY m.lead_id ORDER BY m.arrival_no, i.type, coalesce(i.detail, '')) AS place FROM items i JOIN merged m USING (doc_id))
SELECT lead_id, place, doc_id, type FROM placed WHERE place <= 6""")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir)))
    return G.first_issues(keyed, review_items(spark, sf_dir), 6)


@query(f""", {LEADS} SELECT (SELECT count(*) FROM facts) AS files, (SELECT count(*) FROM facts WHERE status = 'failed') AS failed, count(*) AS leads, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'needs_review') AS review, count(*) FILTER (status = 'complete' AND company_name <> 'Unassociated') AS ready,
 CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_score, CAST(floor((SELECT count(*) FROM facts WHERE status IN ('complete', 'needs_review', 'failed', 'stopped', 'skipped')) * 100 / (SELECT count(*) FROM facts) + 0.5) AS BIGINT) AS progress FROM leads""")
def header_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.facts(spark, sf_dir)
    return G.header_stats(f, _leads(spark, sf_dir))


@query(f""", {LEADS} SELECT count(*) FILTER (company_name = 'Unassociated') AS missing_company, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (score > 0 AND score < 70) AS low_score,
 CAST(sum(duplicate_count) AS BIGINT) AS duplicate_issues, count(*) FILTER (status = 'complete' AND company_name <> 'Unassociated') AS ready FROM leads""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit_summary(_leads(spark, sf_dir))


@query(f""", {LEADS}, o AS (SELECT lead_id, row_number() OVER (ORDER BY revenue DESC, score DESC, lower(company_name), lead_id) - 1 AS position FROM leads) SELECT lead_id, position, ['ann', 'bo', 'cy'][position % 3 + 1] AS rep FROM o""")
def assign_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assign_leads(_leads(spark, sf_dir), ["ann", "bo", "cy"])


@query(f""", {LEADS} SELECT lead_id, company_name, revenue FROM leads WHERE company_name <> 'Unassociated' AND contains(lower(concat_ws(' ', company_name, owner_name)), '7') AND status = 'needs_review' ORDER BY revenue DESC, lower(company_name), lead_id LIMIT 50""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.search_results(_leads(spark, sf_dir), "7", "needs_review", limit=50).select("lead_id", "company_name", "revenue")


@query(f""", {LEADS}, s AS (SELECT lead_id, CASE WHEN has_application AND statement_count = 0 THEN 'application' WHEN NOT has_application AND statement_count > 0 THEN 'statement' END AS side FROM leads)
 SELECT lead_id, side, (SELECT count(*) FROM s t WHERE t.side <> s.side) AS others FROM s WHERE side IS NOT NULL""")
def possible_same_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.possible_same_business(_leads(spark, sf_dir))


AS_PRINTED = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _differing(keyed: DataFrame) -> DataFrame:
    """Every seventh document has another address, every second a trade name in one of two spellings."""
    n, number = F.col("doc_id"), F.floor(F.col("doc_id") / 6).cast("string")
    trade = F.when(n % 4 == 1, F.concat(F.lit("Trade "), number)).when(n % 4 == 3, F.concat(F.lit("TRADE-"), number, F.when(n % 3 == 0, " East").otherwise("")))
    return keyed.withColumns({"address": F.when(n % 7 == 3, "99 Other Rd, Dallas, TX 75201").otherwise(F.col("address")), "dba": trade})


@query(f""", {MERGED}, m AS (SELECT *, CASE WHEN doc_id % 7 = 3 THEN '99 Other Rd, Dallas, TX 75201' ELSE company_no || ' Main St, Austin, TX 78753' END AS address, CASE doc_id % 4 WHEN 1 THEN 'Trade ' || company_no WHEN 3 THEN 'TRADE-' || company_no || CASE WHEN doc_id % 3 = 0 THEN ' East' ELSE '' END END AS dba FROM merged),
a AS (SELECT lead_id, company AS n, dba AS d, address AS w FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY {RANK_SQL}) AS p FROM m WHERE doc_type = 'application') WHERE p = 1),
s AS (SELECT m.lead_id, count(DISTINCT lower(company)) AS name_count, count(DISTINCT lower(dba)) AS dba_count, count(DISTINCT address) AS address_count, bool_or(coalesce({AS_PRINTED.format('company')} <> {AS_PRINTED.format('n')}, false)) AS name_differs, bool_or(coalesce({AS_PRINTED.format('dba')} <> {AS_PRINTED.format('d')}, false)) AS dba_differs, bool_or(coalesce(address <> w, false)) AS address_differs FROM m LEFT JOIN a USING (lead_id) WHERE doc_type = 'bank_statement' GROUP BY 1)
SELECT DISTINCT m.lead_id, {', '.join(f'coalesce({x}_count, 0) AS {x}_count, coalesce({x}_differs, false) AS {x}_differs' for x in ('name', 'dba', 'address'))} FROM m LEFT JOIN s USING (lead_id)""")
def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.company_info(_differing(G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir)))))


@query("""SELECT lead_id, string_agg AS entry, row_number() OVER (PARTITION BY lead_id ORDER BY newest DESC, no DESC) AS place FROM (SELECT company_no AS lead_id, bank || ' • ' || account AS string_agg, max(coalesce(period_end, '')) AS newest, max(-arrival_no) AS no FROM facts WHERE doc_type = 'bank_statement' AND bank IS NOT NULL GROUP BY company_no, bank, account)""")
def bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bank_accounts(B.facts(spark, sf_dir).withColumn("lead_id", F.floor(F.col("doc_id") / 6).cast("long")))


@query("""SELECT company_no, value, row_number() OVER (PARTITION BY company_no ORDER BY first) AS place FROM (SELECT company_no, lower(company), min_by(company, arrival_no) AS value, min(arrival_no) AS first FROM facts WHERE company IS NOT NULL GROUP BY 1, 2)""")
def distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.facts(spark, sf_dir).select(F.floor(F.col("doc_id") / 6).cast("long").alias("company_no"), F.col("company").alias("value"), "arrival_no")
    return G.distinct_ci(f, ["company_no"])


@query(f""", {POSITIONS} SELECT lead_id, funder, CAST(floor(CAST(sum(CAST(monthly_burden AS DECIMAL(18,2))) AS DOUBLE) + 0.5) AS BIGINT) AS burden FROM (SELECT {KEY} AS lead_id, * FROM facts) JOIN positions USING (doc_id) GROUP BY 1, 2""")
def burden_by_funder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.burden_by_funder(_positions(spark, sf_dir), G.lead_keys(B.facts(spark, sf_dir)).select("lead_id", "doc_id"))


@query("""SELECT f.doc_id, CASE WHEN x.low AND status IN ('queued', 'stopped') THEN 'skipped' ELSE status END AS status, coalesce(x.low AND status IN ('queued', 'stopped'), false) AS excluded FROM facts f LEFT JOIN (SELECT DISTINCT company_no, true AS low FROM facts WHERE company_no % 3 = 0 AND doc_type = 'application' AND stated_revenue < 6000 AND status <> 'failed') x
 ON x.company_no = f.company_no AND f.company_no % 3 = 0""")
def exclude_low_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.exclude_low_revenue(B.facts(spark, sf_dir), 6000).select("doc_id", "status", "excluded")


@query("""SELECT doc_id, CASE WHEN status = 'ocr' THEN 'stopped' ELSE status END AS status, CASE WHEN status = 'ocr' THEN 0 ELSE doc_id % 3 END AS attempts, CASE WHEN status = 'ocr' THEN 'scan_interrupted' END AS error FROM facts""")
def recover_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.facts(spark, sf_dir).select("doc_id", "status", (F.col("doc_id") % 3).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return G.recover_statuses(s)


@query(f"""SELECT status, count(*) AS documents, floor(avg(s) FILTER (s > 0) * 10 + 0.5) / 10 AS mean_score, count(*) FILTER (doc_type = 'bank_statement' AND reconciles) AS proven, count(*) FILTER (doc_type = 'bank_statement' AND reconciles = false) AS mismatched FROM (SELECT *, {SCORE} AS s FROM facts) GROUP BY 1""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.batch_report(B.facts(spark, sf_dir))


@query("SELECT doc_type, count(*) AS documents FROM facts GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.facts(spark, sf_dir).groupBy("doc_type").agg(F.count("*").cast("long").alias("documents"))


@query(f"""SELECT doc_id, filename, CASE WHEN status IN ('complete', 'needs_review', 'failed') THEN status ELSE 'needs_review' END AS status, company AS company_name, CASE WHEN doc_id % 4 = 1 THEN 'Trade ' || company_no END AS dba, CASE WHEN doc_type = 'bank_statement' THEN company END AS statement_name, company_no || ' Main St, Austin, TX 78753' AS address, bank,
 'XXXX' || right(account, 4) AS account_number, nullif(concat_ws(' - ', CASE WHEN doc_id % 3 = 0 THEN substr(period_end, 6, 2) || '/01/' || left(period_end, 4) END, substr(period_end, 6, 2) || '/' || right(period_end, 2) || '/' || left(period_end, 4)), '') AS statement_period, CAST(doc_id AS DOUBLE) AS opening_balance, CASE WHEN doc_id % 3 <> 0 THEN doc_id * CAST(1.5 AS DOUBLE) END AS ending_balance,
 CAST(total_deposits AS DOUBLE) AS deposits, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS DOUBLE) AS withdrawals, reconciles, CAST(true_revenue AS DOUBLE) AS revenue, CASE WHEN level IN ('high', 'medium', 'low') THEN level END AS confidence_level, doc_id % 6 AS pages_read, used_ocr, floor(CAST(points AS DOUBLE) / 4 * 100 + 0.5) / 100 AS extraction_score, NULL AS time_taken FROM facts""")
def document_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    f = B.facts(spark, sf_dir).withColumns({
        "summary_withdrawals": F.when(n % 2 == 0, n.cast("double")), "total_debits": (n + 1).cast("double"), "dba": F.when(n % 4 == 1, F.concat(F.lit("Trade "), F.floor(n / 6).cast("string"))), "holder_name": F.when(F.col("doc_type") == "bank_statement", F.col("company")),
        "period_start": F.when(n % 3 == 0, F.concat(F.substring("period_end", 1, 8), F.lit("01"))), "opening": n.cast("double"), "ending": F.when(n % 3 != 0, n * 1.5), "pages_read": n % 6,
    })
    return G.document_sheet(f)


MISSING = "CASE WHEN used_ocr THEN 'OCR failed' ELSE 'Blank' END"


@query(f"""SELECT doc_id, coalesce(bank, {MISSING}) AS bank, CASE WHEN bank IS NULL AND company IS NULL THEN {MISSING} ELSE concat_ws(' / ', bank, company) END AS names, CASE WHEN true_revenue IS NULL THEN {MISSING} ELSE '$' || format('{{:,}}', CAST(floor(true_revenue + 0.5) AS BIGINT)) END AS revenue FROM facts""")
def display_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, ocr = F.col, F.col("used_ocr")
    names = F.array_join(G.display_list(F.array("bank", F.lit(" "), "company"), ocr), " / ")
    return B.facts(spark, sf_dir).select("doc_id", G.display_value(c("bank"), ocr).alias("bank"), names.alias("names"), G.display_money(c("true_revenue"), ocr).alias("revenue"))


@query("""SELECT doc_id, 'status' AS field, status AS old, 'complete' AS new FROM facts WHERE doc_id % 5 = 0 AND status <> 'complete' UNION ALL SELECT doc_id, 'bank', bank, NULL FROM facts WHERE doc_id % 7 = 0 AND bank IS NOT NULL""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = B.facts(spark, sf_dir).select("doc_id", "status", "bank", "level")
    after = before.withColumns({"status": F.when(F.col("doc_id") % 5 == 0, "complete").otherwise(F.col("status")), "bank": F.when(F.col("doc_id") % 7 != 0, F.col("bank"))})
    return G.run_diff(before, after, ["status", "bank", "level"])


@query(f""", {POSITIONS}, {B.LEDGER_SQL.split('balanced AS')[0].rstrip().rstrip(',')}, k AS (SELECT doc_id, {KEY} AS lead_id FROM facts),
p AS (SELECT lead_id, first(funder ORDER BY n DESC, funder) AS funder FROM positions JOIN k USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(description), '\\d{{3,}}', '', 'g'), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), 1, 3), ' ') AS counterparty, CAST(sum(amount) AS DOUBLE) AS total FROM ledger WHERE direction = 'debit' AND amount IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT lead_id, first(counterparty ORDER BY total DESC, counterparty DESC) AS counterparty FROM c JOIN k USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT DISTINCT k.lead_id, CASE WHEN p.funder IS NOT NULL AND false THEN '' WHEN p.funder IS NOT NULL THEN 'Paying ' || p.funder WHEN r.counterparty IS NOT NULL THEN 'Recurring: ' || r.counterparty ELSE 'No recurring payments seen' END AS pitch FROM k LEFT JOIN p USING (lead_id) LEFT JOIN r USING (lead_id)""")
def lead_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = G.lead_keys(B.facts(spark, sf_dir)).select("doc_id", "lead_id")
    recurring = A.recurring_expenses(B.ledger(spark, sf_dir)).join(k, "doc_id").where("doc_id % 2 = 0")
    return G.lead_pitch(k.select("lead_id").distinct(), _positions(spark, sf_dir).join(k, "doc_id"), recurring)


@query(f""", {MERGED}, carried AS (SELECT m.lead_id, m.doc_type, CASE WHEN doc_type = 'application' AND company_no % 4 = 0 THEN m.doc_id ELSE m.duplicate_of END AS duplicate_of, m.arrival_no, CAST(2125550000 + m.doc_id AS VARCHAR) AS phone, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.org' AS email FROM merged m JOIN customer ON c_custkey = m.doc_id),
forms AS (SELECT *, bool_or(duplicate_of IS NULL) OVER w AS any_unique, min(arrival_no) OVER w AS first_no FROM carried WHERE doc_type = 'application' WINDOW w AS (PARTITION BY lead_id)),
good AS (SELECT * FROM forms WHERE CASE WHEN any_unique THEN duplicate_of IS NULL ELSE arrival_no = first_no END)
SELECT DISTINCT lead_id, 'phone' AS kind, phone AS value FROM good UNION SELECT DISTINCT lead_id, 'email', email FROM good""")
def lead_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array((F.col("c_custkey") + 2125550000).cast("string")).alias("phones"), F.array(F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@example.org"))).alias("emails"))
    keyed = G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir))).join(c, "doc_id")
    again = (F.col("doc_type") == "application") & (F.floor(F.col("doc_id") / 6) % 4 == 0)  # all applications of every fourth company are duplicates
    return G.lead_contacts(keyed.withColumn("duplicate_of", F.when(again, F.col("doc_id")).otherwise(F.col("duplicate_of"))))


@query(f""", {MERGED}, b AS (SELECT lead_id, count(*) FILTER (reconciles IS NOT NULL) AS checked, count(*) FILTER (NOT reconciles) AS failing FROM (SELECT lead_id, CASE WHEN duplicate_of IS NULL AND doc_type = 'bank_statement' AND NOT is_mtd THEN reconciles END AS reconciles FROM merged) GROUP BY 1)
SELECT lead_id, checked, failing, CASE WHEN failing > 0 THEN chr(9888) || ' ' || (checked - failing) || '/' || checked WHEN checked > 0 THEN chr(10003) || ' ' || checked || '/' || checked END AS badge FROM b""")
def reconciliation_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reconciliation_badge(G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir))))

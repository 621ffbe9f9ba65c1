"""Queries over positioned text derived from documents, and streams replayed over the tables with availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_space
from ..operators import leads as G
from ..operators import statements as S
from ..sources import bridge as B
from ..sources.store import shared_dir
from ..sources import files
from ..streaming import jobs
from .lead_queries import LEADS
from .text_queries import ORACLE_SQL as TEXT_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text item per word of a document's first words a row: ten words a row, twelve units down, sixty rows a page."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(clean_space(F.col("text")), " ")).alias("n", "text"))
    row = F.floor(F.col("n") / 10)
    return d.select("doc_id", (F.floor(row / 60) + 1).cast("long").alias("page"), (F.col("n") % 10 * 50.0).alias("x"), (720.0 - row % 60 * 12).alias("y"), F.lit(30.0).alias("width"), F.lit(10.0).alias("size"), "text").where("text <> ''")


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), 1) - 1 AS n FROM documents)
SELECT doc_id, CAST(floor(floor(n / 10) / 60) + 1 AS BIGINT) AS page, CAST(floor(n / 10) % 60 + 1 AS BIGINT) AS row_no, string_agg(word, ' ' ORDER BY n) AS line FROM w GROUP BY doc_id, floor(n / 10)""")
def rows_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rows_from_items(_items(spark, sf_dir))


@query()
def form_rows_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.form_rows_from_items(_items(spark, sf_dir))


@query(f"""WITH {B.FACTS_SQL} SELECT doc_id, doc_type, company, CAST(true_revenue AS DOUBLE) AS true_revenue, reconciles, CAST(len(string_split(filename, '/')) AS BIGINT) AS n_parts, split_part(filename, '/', -1) AS file FROM facts""")
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document facts as nested records, written as JSON lines and read again."""
    f = B.facts(spark, sf_dir)
    nested = f.select("doc_id", F.struct("doc_type", "company").alias("identity"), F.struct(F.struct(F.col("true_revenue").cast("double").alias("true_revenue")).alias("deposits"), "reconciles").alias("statement"), F.split("filename", "/").alias("path"))
    place = _scratch(spark)
    files.write_records(nested, place)
    back = files.read_records(spark, place, nested.schema)
    return back.select("doc_id", "identity.doc_type", "identity.company", "statement.deposits.true_revenue", "statement.reconciles", F.size("path").cast("long").alias("n_parts"), F.element_at("path", -1).alias("file"))


@query("""SELECT doc_id, n = 0 AS empty, CASE WHEN n = 0 THEN 'empty_file' WHEN doc_id % 5 = 4 THEN 'unsupported_file_type' WHEN doc_id % 5 < 2 THEN 'not_a_real_pdf_signature' END AS reason, sha256(text) AS file_hash FROM (SELECT *, length(text) AS n FROM documents)""")
def validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = B.pick(["pdf", "PDF", "png", "jpeg", "txt"], F.col("doc_id"))
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"), F.length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    v = files.validate_files(d).select("path", "reason")
    return d.join(v, "path").select("doc_id", (F.length("content") == 0).alias("empty"), "reason", files.content_hash(F.col("content")).alias("file_hash"))


@query(TEXT_SQL["parse_transactions"])
def stream_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as files, read as a stream four files at a time; equal to the batch answer."""
    at = _scratch(spark)
    S.render_statements(B.ledger(spark, sf_dir)).repartition(8, "doc_id").write.parquet(f"{at}/in")
    docs = spark.readStream.schema("doc_id long, raw_text string").option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    jobs.stream_transactions(docs, f"{at}/out", f"{at}/state", 2024).trigger(availableNow=True).start().awaitTermination()
    t = spark.read.parquet(f"{at}/out")
    return t.select("doc_id", "txn_no", "date_text", "description", F.col("amount").cast("double").alias("amount"), "direction", "direction_source", "section", "check_number", "confidence")


@query("SELECT sha256(text) AS file_hash, n_chars AS file_size, 1 AS copies FROM documents GROUP BY text, n_chars")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replayed as one stream of files; each hash and size passes once."""
    at = _scratch(spark)
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.col("n_chars").alias("file_size"), F.timestamp_seconds(1700000000 + F.col("doc_id") % 60).alias("arrived"))
    d.write.parquet(f"{at}/in")
    stream = spark.readStream.schema("doc_id long, file_hash string, file_size long, arrived timestamp").parquet(f"{at}/in")
    jobs.stream_dedupe(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, file_hash string, file_size long, arrived timestamp").parquet(f"{at}/out").groupBy("file_hash", "file_size").agg(F.count("*").cast("int").alias("copies"))


@query(f"WITH {B.FACTS_SQL}\n, {LEADS} SELECT * FROM leads")
def stream_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document facts with their leads, replayed a few files at a time; equal to the batch answer."""
    at = _scratch(spark)
    keyed = G.merge_same_address(G.lead_keys(B.facts(spark, sf_dir)))
    keyed.repartition(4).write.parquet(f"{at}/in")
    facts = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    jobs.stream_leads(facts, f"{at}/store", f"{at}/state", parts=4).trigger(availableNow=True).start().awaitTermination()
    return jobs.read_store(spark, f"{at}/store")

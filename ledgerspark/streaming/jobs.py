"""Structured Streaming: documents to ledger rows, duplicates across batches, and a lead table kept fresh.

The work of each job is a batch operator of this library; foreachBatch runs it on whole documents, so a stream
and a batch over the same rows give the same tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.leads import lead_facts
from ..operators.statements import parse_transactions


def stream_transactions(docs: DataFrame, out: str, checkpoint: str, statement_year: int) -> DataStreamWriter:
    """Statement texts (doc_id, raw_text) as they arrive to ledger rows in Parquet, partitioned by batch. A batch that
    runs again overwrites its own partition, so each document counts once."""

    def write(batch: DataFrame, no: int) -> None:
        parse_transactions(batch, statement_year).write.mode("overwrite").parquet(f"{out}/batch={no}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_dedupe(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Files (arrived, file_hash, file_size, ...) without those equal in hash and size to one seen within `delay` before;
    later ones pass, and the state stays bounded. Files without a hash always pass."""
    keyed = files.withColumn("_key", F.coalesce(F.col("file_hash"), F.expr("uuid()")))
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["_key", "file_size"]).drop("_key")


def stream_leads(facts: DataFrame, store: str, checkpoint: str, parts: int = 16, keep: int = 2) -> DataStreamWriter:
    """Document facts with lead_id as they arrive to a lead store, the last fact of each document and the leads of those, in `parts`
    parts by lead; a batch reads and writes only parts it touches. read_store gives its tables.

    A batch writes its parts to a folder of its own, then a manifest of which folder has each part. Readers go by the last whole
    manifest, so they never see facts of one batch beside leads of another; a batch that fails leaves what was there, and runs again over
    its own folder. Folders that none of the last `keep` manifests names are deleted.

    A document that changes its lead is to arrive with both: the old lead_id with status 'skipped', and the new."""

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("lead_id"), F.lit(parts)).cast("int").alias("part")
        new = batch.select("*", F.lit(no).cast("long").alias("batch_no"), part)
        touched = [r[0] for r in new.select("part").distinct().collect()]  # `parts` values at most
        before = _manifest(spark, store, no)
        seen = new.unionByName(_parts(spark, store, "facts", {p: v for p, v in before.items() if p in touched}, new.schema))
        last = seen.groupBy("part", "lead_id", "doc_id").agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("part", "lead_id", "doc_id")]), F.struct("batch_no", "arrival_no")).alias("x")).select("part", "lead_id", "doc_id", "x.*")
        at = f"{store}/data/{no}"
        last.select(*new.columns).write.mode("overwrite").partitionBy("part").parquet(f"{at}/facts")
        now = spark.read.schema(new.schema).parquet(f"{at}/facts")
        lead_facts(now).select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{at}/leads")
        rows = sorted((before | dict.fromkeys(touched, no)).items())
        spark.createDataFrame(rows, "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{store}/manifests/{no}")
        _expire(spark, store, keep)

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_store(spark: SparkSession, store: str, table: str = "leads") -> DataFrame:
    """A table of the store (leads or facts) as of its last whole batch."""
    found = _manifest(spark, store)
    if not found:
        raise ValueError(f"no batch has been written to {store}")
    return _parts(spark, store, table, found).drop("part")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, whole: bool = False) -> list[int]:
    """The numbers that name folders at path; with `whole` only those whose write was committed."""
    fs, p = _files(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x) for x in names if x.isdigit() and (not whole or fs.exists(_files(spark, f"{path}/{x}/_SUCCESS")[1])))


def _manifest(spark: SparkSession, store: str, before: int | None = None) -> dict[int, int]:
    """part -> number of the folder that has it, by the last whole manifest (before a batch's own); a row a part."""
    numbers = [x for x in _numbers(spark, f"{store}/manifests", whole=True) if before is None or x < before]
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version long").parquet(f"{store}/manifests/{numbers[-1]}").collect()} if numbers else {}


def _parts(spark: SparkSession, store: str, table: str, found: dict[int, int], schema: StructType | None = None) -> DataFrame:
    """The parts of a table in the folders that have them: one read for each folder, `parts` at most."""
    reads = []
    for version in sorted(set(found.values())):
        base = f"{store}/data/{version}/{table}"
        reader = spark.read.option("basePath", base)
        reads.append((reader.schema(schema) if schema else reader).parquet(*[f"{base}/part={p}" for p, v in sorted(found.items()) if v == version]))
    return functools.reduce(DataFrame.unionByName, reads) if reads else spark.createDataFrame([], schema)


def _expire(spark: SparkSession, store: str, keep: int) -> None:
    manifests = _numbers(spark, f"{store}/manifests", whole=True)
    used = {v for no in manifests[-keep:] for v in _manifest(spark, store, no + 1).values()}
    for path in [f"{store}/manifests/{no}" for no in manifests[:-keep]] + [f"{store}/data/{no}" for no in _numbers(spark, f"{store}/data") if no not in used and no < manifests[-1]]:
        fs, p = _files(spark, path)
        fs.delete(p, True)

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session, as in tests, may lack it and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written once in buckets of key, and read again: groupings, windows and joins by key then need no shuffle."""
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    out = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(df.sparkSession)}/{name}")
    out.saveAsTable(name)
    return df.sparkSession.table(name)


def kept(df: DataFrame) -> DataFrame:
    """df written and read again; a lost executor then costs the tasks it had."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

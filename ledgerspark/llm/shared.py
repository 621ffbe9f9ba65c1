"""What the operators of this subpackage share: tables in the shared folder, row keys, word rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (a local session, as in tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Tables:
    """Parquet tables in the shared folder that cut a job's lineage; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """df, written and read again."""
        return self.keep_at(df, codec)[0]

    def keep_at(self, df: DataFrame, codec: str = "snappy") -> tuple[DataFrame, str]:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def release(self) -> None:
        """Has Spark delete shuffle files of finished jobs: its cleaner follows the driver's garbage collection."""
        for _ in range(2):  # the first lets go of what Python held
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)

    def drop(self, path: str) -> None:
        """Deletes a table that nothing reads any more."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Gives freed memory of this process back to the system, which Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run):
    """run, for mapInArrow: a worker that waits for its next task holds no freed memory beside the JVM of other stages."""

    def of(batches):
        yield from run(batches)
        give_back()

    return of


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (null: empty) alone, whatever other columns df has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas of body."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

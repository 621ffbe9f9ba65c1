"""Files and positioned text as sources: reading, validation, hashing, and rows from text items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("pdf", "png", "jpg", "jpeg")
ITEMS = "doc_id, page, x, y, width, size, text"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the documents below a folder; arrival order is the order of paths. Spark's reader lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(extension(F.col("path")).isin(*KINDS)).select("path", "length", "content")


def validate_files(files: DataFrame) -> DataFrame:
    """valid, reason (the first of empty_file, unsupported_file_type, not_a_real_pdf_signature) and warnings of files
    (path, length, content). A PDF without %%EOF or startxref in its last 2048 bytes has a warning; without both it
    looks corrupted, and is valid still. Null content is empty."""
    kind = extension(F.col("path"))
    head, tail = F.substring("content", 1, 5).cast("string"), F.expr("decode(substring(content, greatest(length(content) - 2047, 1), 2048), 'ISO-8859-1')")
    n = F.coalesce(F.length("content"), F.lit(0))
    reason = F.when(n == 0, "empty_file").when(~kind.isin(*KINDS), "unsupported_file_type").when((kind == "pdf") & ~F.coalesce(head == "%PDF-", F.lit(False)), "not_a_real_pdf_signature")
    pdf = (kind == "pdf") & reason.isNull()
    no_eof, no_xref = pdf & ~tail.contains("%%EOF"), pdf & ~tail.contains("startxref")
    warnings = F.array_compact(F.array(F.when(no_eof, "missing_eof_marker"), F.when(no_xref, "missing_startxref")))
    return files.select("path", "length", reason.isNull().alias("valid"), reason.alias("reason"), warnings.alias("warnings"), (no_eof & no_xref).alias("looks_corrupted"))


def write_records(docs: DataFrame, path: str, form: str = "json") -> None:
    """Document records with nested structs and arrays, one row a document, as JSON lines or Parquet; nulls are kept as nulls."""
    out = docs.write.mode("overwrite")
    (out.option("ignoreNullFields", False).json(path) if form == "json" else out.parquet(path))


def read_records(spark: SparkSession, path: str, schema: StructType, form: str = "json") -> DataFrame:
    """The records written by write_records, with the schema they had; a JSON line that isn't a record fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path) if form == "json" else spark.read.schema(schema).parquet(path)


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, 64 hexadecimal digits; null for null."""
    return F.sha2(content, 256)


def rows_from_items(items: DataFrame, page_cap: int | None = None) -> DataFrame:
    """doc_id, page, row_no, line: items (doc_id, page, x, y, width, size, text) put together by height, then from left to right.

    A space stands where the gap to the item before is half a unit or 12 % of its size, whichever is more."""
    kept = items if page_cap is None else items.where(F.col("page") <= page_cap)
    bucket = (F.floor(F.col("y") / 2 + 0.5) * 2).alias("bucket")
    g = kept.groupBy("doc_id", "page", bucket).agg(F.array_sort(F.collect_list(F.struct("x", "width", "size", "text"))).alias("items"))
    start = F.struct(F.lit("").alias("line"), F.lit(None).cast("double").alias("cursor"))

    def add(state: Column, item: Column) -> Column:
        gap = item["x"] - state["cursor"] >= F.greatest(F.lit(0.5), item["size"] * 0.12)
        return F.struct(F.concat(state["line"], F.when(gap, " ").otherwise(""), F.coalesce(item["text"], F.lit(""))).alias("line"), (item["x"] + item["width"]).cast("double").alias("cursor"))

    line = F.trim(F.regexp_replace(F.aggregate("items", start, add)["line"], r"\s+", " "))
    rows = g.select("doc_id", "page", "bucket", line.alias("line")).where("line <> ''")
    return rows.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("bucket"))).cast("long").alias("row_no"), "line")


def _cells(row: list[dict]) -> list[tuple[float, str]]:
    """Runs of items with less than 24 units between them, as (x, text)."""
    out: list[tuple[float, str]] = []
    end = None
    for it in row:
        if end is None or it["x"] - end >= 24:
            out.append((it["x"], it["text"]))
        else:
            out[-1] = (out[-1][0], out[-1][1] + (" " if it["x"] - end >= max(0.5, it["size"] * 0.12) else "") + it["text"])
        end = it["x"] + it["width"]
    return [(x, " ".join(t.split())) for x, t in out if t.strip()]


def form_page(items: list[dict]) -> list[str]:
    """The lines of one page of a form: near rows joined, and a row of labels paired with the row of answers under it."""
    rows: dict[float, list[dict]] = {}
    for it in items:
        rows.setdefault(2 * ((it["y"] / 2 + 0.5) // 1), []).append(it)
    merged: list[list[dict]] = []
    for key in sorted(rows, reverse=True):
        if merged and min(i["y"] for i in merged[-1]) - max(i["y"] for i in rows[key]) < 2:
            merged[-1] += rows[key]
        else:
            merged.append(list(rows[key]))
    cells = [_cells(sorted(r, key=lambda i: i["x"])) for r in merged]
    heights = [max(i["y"] for i in r) for r in merged]
    out, i = [], 0
    while i < len(cells):
        here, below = cells[i], cells[i + 1] if i + 1 < len(cells) else []
        pairs = len(here) == len(below) >= 2 and 0 < heights[i] - heights[i + 1] <= 20 and all(abs(a[0] - b[0]) <= 6 for a, b in zip(here, below, strict=True))
        if pairs and 2 * sum(not any(c.isdigit() for c in t) for _, t in here) >= len(here):
            out += [f"{a[1]} {b[1]}" for a, b in zip(here, below, strict=True)]
            i += 1
        elif here:
            out.append(" ".join(t for _, t in here))
        i += 1
    return out


def form_rows_from_items(items: DataFrame) -> DataFrame:
    """doc_id, page, row_no, line in form layout; a page is one group."""

    def run(table: pa.Table) -> pa.Table:
        lines = form_page([x for x in table.to_pylist() if x["text"]])
        n = len(lines)
        return pa.table({"doc_id": [table["doc_id"][0].as_py()] * n, "page": pa.array([table["page"][0].as_py()] * n, pa.int64()), "row_no": pa.array(range(1, n + 1), pa.int64()), "line": pa.array(lines, pa.string())}).cast(pa.schema([("doc_id", table.schema.field("doc_id").type), ("page", pa.int64()), ("row_no", pa.int64()), ("line", pa.string())]))

    kind = items.schema["doc_id"].dataType.simpleString()
    return items.withColumn("page", F.col("page").cast("long")).groupBy("doc_id", "page").applyInArrow(run, f"doc_id {kind}, page long, row_no long, line string")

"""Packing by large-item matching: few windows for all documents, none cut that fits one.

A document longer than a window is cut into whole windows, its first piece taking what is over.
At most two pieces above a third of a window fit one, so those are matched greedily: each, longest
first, with the longest partner that fits, which makes as many pairs as can be. The others, longest
first, go into the tightest gap that holds them.

Pieces of one length are alike, so the whole corpus is packed at once from its counts by length:
the plan is a list of runs ("pieces of this length from rank r on lie in windows from w on"), made
from `window` counts whatever the size of the corpus. Ranks come from counts by length and bucket
and a row number inside a bucket; a task looks its pieces up in the runs. The runs are at most about
window / 3 times the open gap ranges (2 * window), whatever the input.

Defined cases: a null text is empty, an empty text is the end id alone; a null doc_id is kept;
repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import Tables, documents

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(docs: DataFrame, tokenizer: str, kind: str, end_id: int, window: int, keep_ids: bool) -> DataFrame:
    """Each document's pieces with the unsigned CRC-32 of their ids: whole if it fits a window, else full windows after a first piece."""

    def run(batches):
        coder = tokens.pieces(tokenizer, kind)
        for batch in batches:
            for some in tokens.groups(batch, 1, 2_000_000):
                ids, edges = coder.encode_with_end(some.column(1), end_id)
                n = np.diff(edges)
                parts = -(-n // window)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = np.maximum(0, n[doc] - (parts[doc] - piece) * window)
                bounds = np.append(edges[doc] + start, len(ids))
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                kept = [tokens.binaries(ids, bounds)] if keep_ids else []
                columns = [some.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, np.diff(bounds), crc)], *kept]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return documents(docs).mapInArrow(run, PIECE if keep_ids else PIECE.removesuffix(", ids binary"))


class Plan:
    """Runs of equal pieces: (length, first rank, first window, pieces a window, offset of the first in it)."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.windows, self.runs = window, 0, []
        self.left, self.placed = dict(counts), dict.fromkeys(counts, 0)
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # ranges of windows with that much room
        self.some = 0  # a bit for each gap that has windows
        large = sorted((x for x in counts if 3 * x > window), reverse=True)
        for size in large:
            self._match(size, [x for x in large if x <= min(size, window - size)])
        for size in sorted((x for x in counts if 3 * x <= window), reverse=True):
            self._fill(size)

    def _put(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        self.runs.append((size, self.placed[size], first, each, offset))
        self.placed[size] += n
        self.left[size] -= n

    def _open(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.gaps[gap].append((first, n))
            self.some |= 1 << gap

    def _match(self, size: int, partners: list[int]) -> None:
        """Windows that begin with a piece of this size, with the longest partners that fit."""
        for other in partners:
            n = min(self.left[size], self.left[other]) if other != size else self.left[size] // 2
            if n:
                if other == size:
                    self._put(size, 2 * n, self.windows, 2, 0)
                else:
                    self._put(size, n, self.windows, 1, 0)
                    self._put(other, n, self.windows, 1, size)
                self._open(self.window - size - other, self.windows, n)
                self.windows += n
        if n := self.left[size]:
            self._put(size, n, self.windows, 1, 0)
            self._open(self.window - size, self.windows, n)
            self.windows += n

    def _fill(self, size: int) -> None:
        """Pieces of this size into the tightest gaps; a gap takes as many as it holds before the next one is touched."""
        while self.left[size]:
            fits = self.some >> size
            if fits:
                gap = size + (fits & -fits).bit_length() - 1
                first, n = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    self.some &= ~(1 << gap)
            else:
                gap, first, n = self.window, self.windows, -(-self.left[size] // (self.window // size))
                self.windows += n
            each = gap // size
            full = min(n, self.left[size] // each)
            if full:
                self._put(size, full * each, first, each, self.window - gap)
                self._open(gap - each * size, first, full)
            if full < n and 0 < self.left[size] < each:
                some = self.left[size]
                self._put(size, some, first + full, some, self.window - gap)
                self._open(gap - some * size, first + full, 1)
                full += 1
            self._open(gap, first + full, n - full)


def pack_matched(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, window: int = 1024, keep_ids: bool = True, bucket_size: int = 16_384) -> DataFrame:
    """One row per piece with its place: sequence_id, offset, and with keep_ids its ids (binary, little-endian)."""
    tables = Tables(docs.sparkSession, "pairing")
    found = tables.keep(cut(docs, tokenizer, kind, end_id, window, keep_ids))
    buckets = max(1, -(-found.count() // bucket_size))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = tables.keep(found.groupBy("length", "bucket").count())
    plan = Plan({x["length"]: x["n"] for x in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, window)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    begins = (runs[:, 0] << 48) | runs[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            run = runs[np.searchsorted(begins, (length << 48) | rank, side="right") - 1]
            nth = rank - run[:, 1]
            table = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)], [*table.schema.names, "sequence_id", "offset"])

    key = ["length", "bucket"]
    before = counts.select(*key, (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    at = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = found.withColumn("at", at).join(before, key).withColumn("rank", F.col("before") + F.col("at") - 1)
    schema = PIECE if keep_ids else PIECE.removesuffix(", ids binary")
    return ranked.select(*[x.split()[0] for x in schema.split(", ")], "rank").mapInArrow(place, schema + ", sequence_id long, offset long")

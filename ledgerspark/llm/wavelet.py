"""Token-ID output: one file of wavelet matrices per shard.

A shard holds documents in ascending doc_id order, in blocks of about `block_tokens` ids. A block's
ids are stored as bit planes, highest bit first; each plane orders the ids by the bits above it
(zeros first, stable), so rank on the planes gives access, counting and select without decoding.
A block is one row of the shard's Parquet file (zstd): the planes, the number of zeros of each, the
planes' rank directories (ones before every 512 bits), its documents and their lengths. Rank adds up
eight words at most after the directory's count; select is a search in the directory, then in those words.

Defined cases: a null text is empty (the end id alone); null doc_ids come first; repeated rows are
kept, side by side; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import Tables, documents

BLOCK = "shard long, block long, n_tokens long, width int, zeros array<long>, planes array<binary>, ranks array<binary>, doc_ids array<long>, lengths array<long>"
_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


class Matrix:
    """A wavelet matrix over n unsigned ids of `width` bits."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.width, self.zeros = n, width, zeros
        self.words = [np.frombuffer(x, "<u8") for x in planes]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @staticmethod
    def build(ids: np.ndarray, width: int) -> Matrix:
        """Raises ValueError if an id needs more than `width` bits."""
        if len(ids) and int(ids.max()) >> width:
            raise ValueError(f"the id {int(ids.max())} has more than {width} bits")
        zeros, planes, ranks, now = [], [], [], ids.astype(np.uint16 if width <= 16 else np.uint32)
        for b in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << b)) != 0
            words = np.zeros(8 * ((len(now) >> 9) + 1), "<u8")
            raw = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(raw)] = raw
            counts = np.bitwise_count(words).reshape(-1, 8).sum(1, dtype=np.uint32)
            planes.append(words.tobytes())
            ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
            zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        return Matrix(len(ids), width, zeros, planes, ranks)

    def rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        words, word, low = self.words[plane], at >> 6, (at & 63).astype(np.uint64)
        out = self.ranks[plane][at >> 9].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << low) - np.uint64(1)))
        for back in range(1, 8):  # the words of the same 512 bits before this one
            out += np.where((word & 7) >= back, np.bitwise_count(words[np.maximum(word - back, 0)]), 0)
        return out

    def select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The position of the k-th (from 0) one, or zero, of a plane."""
        ranks, flip = self.ranks[plane].astype(np.int64), np.uint64(0 if bit else (1 << 64) - 1)
        before = ranks if bit else 512 * np.arange(len(ranks)) - ranks
        block = np.searchsorted(before, k, side="right") - 1
        left, word = k - before[block], 8 * block
        for _ in range(7):
            n = np.bitwise_count(self.words[plane][word] ^ flip).astype(np.int64)
            on = left >= n
            left, word = np.where(on, left - n, left), np.where(on, word + 1, word)
        bits, at = self.words[plane][word] ^ flip, word << 6
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= n
            left, at = np.where(on, left - n, left), np.where(on, at + half, at)
            bits = np.where(on, bits >> np.uint64(half), bits)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for p in range(self.width):
            bit = (self.words[p][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self.rank1(p, at)
            at = np.where(bit == 1, self.zeros[p] + ones, at - ones)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
        return out

    def all(self) -> np.ndarray:
        """Every id in order: from the last plane up, each plane's zeros and ones take back their places."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for p in range(self.width - 1, -1, -1):
            bits = np.unpackbits(self.words[p].view(np.uint8), bitorder="little", count=self.n).view(bool)
            here = np.empty(self.n, kind)
            here[bits] = below[self.zeros[p] :] | kind(1 << (self.width - 1 - p))
            here[~bits] = below[: self.zeros[p]]
            below = here
        return below

    def range_of(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences before position end lie below the last plane."""
        low, high = 0, end
        for p in range(self.width):
            ones = self.rank1(p, np.array([low, high]))
            if symbol >> (self.width - 1 - p) & 1:
                low, high = (int(self.zeros[p] + x) for x in ones)
            else:
                low, high = int(low - ones[0]), int(high - ones[1])
        return low, high

    def count(self, symbol: int, end: int | None = None) -> int:
        """Occurrences before position end (default: all)."""
        if symbol >> self.width:
            return 0
        low, high = self.range_of(symbol, self.n if end is None else end)
        return high - low

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of the symbol in ascending order, by select from the last plane up."""
        if symbol >> self.width:
            return np.zeros(0, np.int64)
        low, high = self.range_of(symbol, self.n)
        at = np.arange(low, high)
        for p in range(self.width - 1, -1, -1):
            one = symbol >> (self.width - 1 - p) & 1
            at = self.select(p, one, at - one * self.zeros[p])
        return at


def _row(shard: int, block: int, ids: np.ndarray, width: int, names: list, lengths: list[int]) -> pa.RecordBatch:
    m = Matrix.build(ids, width)
    row = {"shard": shard, "block": block, "n_tokens": m.n, "width": width, "zeros": m.zeros, "planes": [x.tobytes() for x in m.words], "ranks": [x.tobytes() for x in m.ranks], "doc_ids": names, "lengths": lengths}
    return pa.RecordBatch.from_pylist([row], _ARROW)


def write_shards(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, width: int = 16, docs_per_shard: int = 16_384, block_tokens: int = 1 << 20) -> None:
    """Writes one file per shard of about docs_per_shard documents to path, any file system that Spark writes."""
    shards = tokens.shards_of(docs, docs_per_shard)

    def run(batches):
        coder = tokens.pieces(tokenizer, kind)
        shard, block, ids, names, lengths, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            for some in tokens.groups(batch, 1, 2 * block_tokens):
                found, edges = coder.encode_with_end(some.column(1), end_id)
                ids.append(found)
                names += some.column(0).to_pylist()
                lengths += np.diff(edges).tolist()
                size += len(found)
                if size >= block_tokens:
                    yield _row(shard, block, np.concatenate(ids), width, names, lengths)
                    block, ids, names, lengths, size = block + 1, [], [], [], 0
        if names:
            yield _row(shard, block, np.concatenate(ids), width, names, lengths)

    ordered = documents(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned) and, with keep_ids, ids (binary) of each document, from the files alone."""
    names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: 6 + keep_ids]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Matrix(row["n_tokens"], row["width"], row["zeros"], row["planes"], row["ranks"]).all().astype("<u4")
                edges, raw = np.concatenate(([0], np.cumsum(row["lengths"]))), memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                n = len(crc)
                columns = [np.full(n, row["shard"]), np.full(n, row["block"]), row["doc_ids"], edges[:-1], row["lengths"], crc]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], *([tokens.binaries(ids, edges)] if keep_ids else [])], names)

    blocks = spark.read.schema(BLOCK).parquet(path)
    docs = blocks.mapInArrow(run, "shard long, block long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    # Tokens before a block: those of earlier shards, one row a shard, and those of earlier blocks of its shard.
    sizes = blocks.select("shard", "block", "n_tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards.hint("merge"), "shard").select("shard", "block", (F.col("first") + F.col("earlier")).alias("first"))
    return docs.join(first.hint("merge"), ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), *names[4:])


def token_files(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, keep_ids: bool = True, **how) -> DataFrame:
    """Writes the documents' shards to the shared folder and reads them back."""
    tables = Tables(docs.sparkSession, "tokens")
    write_shards(docs, f"{tables.base}/shards", tokenizer, kind, end_id, **how)
    return read_shards(docs.sparkSession, f"{tables.base}/shards", keep_ids)

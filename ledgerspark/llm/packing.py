"""Packing: documents' token ids into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each document goes, longest
first, into the open window with the least room that still holds it. A segment tree over the
remaining capacities finds that window. Each shard of about `docs_per_shard` documents is packed
alone, so no task gathers more than a shard, and a shard wastes a few windows at most.

Defined cases: a null text is empty, an empty text is the end id alone; a null doc_id is kept;
repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import documents, give_back, lean

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Room:
    """Open windows by remaining capacity; a segment tree holds how many there are below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_no: int) -> None:
        self.at[capacity].append(window_no)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least size, removed; None if there is none."""
        i, count = size + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right sibling has windows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.at[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths in descending order: the window's number and the offset in it of each."""
    room, numbers, offsets, made = Room(window), [], [], 0
    for size in lengths:
        found = room.take(size) if size < window else None
        if found is None:
            capacity, number = window, made
            made += 1
        else:
            capacity, number = found
        numbers.append(number)
        offsets.append(window - capacity)
        if capacity > size:
            room.add(capacity - size, number)
    return numbers, offsets


def cut(docs: DataFrame, tokenizer: str, kind: str, end_id: int, window: int, keep_ids: bool) -> DataFrame:
    """Each document's full windows and its rest, with the unsigned CRC-32 of the ids."""

    def run(batches):
        coder = tokens.pieces(tokenizer, kind)
        for batch in batches:
            for some in tokens.groups(batch, 1):
                ids, edges = coder.encode_with_end(some.column(1), end_id)
                n = np.diff(edges)
                parts = -(-n // window)
                doc = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                bounds = np.append(edges[doc] + start, len(ids))
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                kept = [tokens.binaries(ids, bounds)] if keep_ids else []
                columns = [some.column(0).take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (start, np.diff(bounds), crc, n[doc])], *kept]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])
            give_back()

    return documents(docs).mapInArrow(lean(run), PIECE if keep_ids else PIECE.removesuffix(", ids binary"))


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, window: int = 1024, keep_ids: bool = True, docs_per_shard: int = 16_384) -> DataFrame:
    """One row per piece with its place: sequence_id, offset, and with keep_ids its ids (binary, little-endian)."""
    shards = tokens.shards_of(docs, docs_per_shard)

    def place(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]))
        numbers, offsets = best_fit(table["length"].to_pylist(), window)
        shard = table["shard"][0].as_py() << 40
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array([shard + x for x in numbers], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    found = cut(docs, tokenizer, kind, end_id, window, keep_ids)
    found = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(shards)))
    schema = PIECE.removesuffix("" if keep_ids else ", ids binary") + ", sequence_id long, offset long"
    return found.groupBy("shard").applyInArrow(place, schema)


def sequences(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, input_ids (array of int), n_tokens: the windows themselves, padded to `window`
    except where the tokens are a power of two in number."""

    def join(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("offset", "ascending")]))
        raw = b"".join(table["ids"].to_pylist())
        n = len(raw) // 4
        if n & (n - 1):
            raw += pad_id.to_bytes(4, "little") * (window - n)
        ids = pa.Array.from_buffers(pa.int32(), len(raw) // 4, [None, pa.py_buffer(raw)])
        return pa.table({"sequence_id": table["sequence_id"].slice(0, 1), "n_tokens": pa.array([n], pa.int64()), "input_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, input_ids array<int>")

"""Token ids of two tokenizers aligned: groups that cover the same bytes, and how each id is told by the other's.

Both tokenizers read a space and the text; a token's end is the number of bytes up to it. Where both
have an end, a group ends. The end arrays of a batch of texts are compared along a diagonal: at the
current shift between the two indices, slices of doubling length are compared until one differs, then
of halving length, so a stretch of one-to-one groups costs a few comparisons however long it is. The
group that broke the stretch is walked token by token to the next common end, which gives the new
shift.

Tables, not the driver, hold what the corpus tells: each text's distinct id pairs are written with it,
counted, and each A id's highest count is joined on. Only the most frequent pairs, at most `head`, are
looked up in a list that every task gets; the others are joined.

Defined cases: texts that are null, empty, or that the tokens don't give back byte by byte have no
tokens, and all their numbers are 0; special tokens' strings are plain text; a null doc_id is kept; a
repeated row counts as a document of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import Tables, documents

#: B ids take the low bits of a pair of ids, A ids the others.
BITS = 16
#: Groups of more links than this are counted by their distinct ids.
MANY = 256
TEXT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary"


def irregular(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The groups of two arrays of ends (int32, equal in their last values) that aren't one to one: rows of first and last + 1 in x, then in y."""
    raw_x, raw_y, ends_x, ends_y = x.tobytes(), y.tobytes(), memoryview(x), memoryview(y)
    n, i, j, out = 4 * len(x), 0, 0, []  # i and j in bytes
    while i < n:
        step = 4
        while raw_x[i : i + step] == raw_y[j : j + step] and i < n:
            i, j, step = i + step, j + step, 2 * step
        while step > 4:
            step //= 2
            if raw_x[i : i + step] == raw_y[j : j + step]:
                i, j = i + step, j + step
        if i < n:
            a, b = i >> 2, j >> 2
            p, q = a, b
            u, v = ends_x[p], ends_y[q]
            while u != v:
                if u < v:
                    p += 1
                    u = ends_x[p]
                else:
                    q += 1
                    v = ends_y[q]
            out.append((a, p + 1, b, q + 1))
            i, j = 4 * p + 4, 4 * q + 4
    return np.array(out, np.int64).reshape(-1, 4)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many things: each thing's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, ten thousands first, and how many digits each has."""
    ids = np.arange(1 << BITS)
    return np.stack([ids // 10**k % 10 + 48 for k in (4, 3, 2, 1, 0)], 1).astype(np.uint8), np.maximum(1, np.searchsorted([1, 10, 100, 1000, 10000], ids, side="right"))


class Aligner:
    """Aligns the texts of an Arrow column by a byte-level BPE file (A) and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens.Pieces(path_a, "byte", plain=True), tokens.Sentences(path_b)
        names = self.a.tokenizer.get_vocab()
        self.size_a = np.zeros(1 << BITS, np.int32)
        for name, i in names.items():
            self.size_a[i] = len(name)  # a character of a byte-level entry is a byte
        self.size_b = np.zeros(1 << BITS, np.int32)
        self.size_b[: len(self.b.bytes)] = [len(x) for x in self.b.bytes]
        self.digits, self.n_digits = _digits()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids of the texts, and the places between texts in each; texts without tokens have none."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        ids_b, edges_b = self.b.encode(spaced)
        bad = np.zeros(len(texts) + 1, np.int64)
        np.add.at(bad, np.searchsorted(edges_b, np.flatnonzero(ids_b == self.b.unlike), side="right") - 1, 1)
        good = (bad[:-1] == 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        if not good.all():
            mask = np.repeat(good, np.diff(edges_b))
            ids_b, edges_b = ids_b[mask], np.concatenate(([0], np.cumsum(np.diff(edges_b) * good)))
            spaced = pc.if_else(pa.array(good), spaced, pa.scalar(""))
        return *self.a.encode(spaced), ids_b, edges_b

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many A ids and how many B ids each group has, in order."""
        ends_a, ends_b = (np.cumsum(size[ids], dtype=np.int32) for size, ids in ((self.size_a, ids_a), (self.size_b, ids_b)))
        odd = irregular(ends_a, ends_b)
        last = []
        for n, first, end in ((len(ids_a), odd[:, 0], odd[:, 1]), (len(ids_b), odd[:, 2], odd[:, 3])):
            inner, place = _spread(end - first - 1)
            ends = np.ones(n, bool)
            ends[first[inner] + place] = False
            last.append(np.flatnonzero(ends))
        return tuple(np.diff(x, prepend=-1) for x in last)

    def told(self, ids_a, ids_b, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
        """The groups as bytes "a1,a2|b1;a3|b2,b3;" and where each group ends in them."""
        group = np.concatenate((np.repeat(np.arange(len(n_a)) * 2, n_a), np.repeat(np.arange(len(n_b)) * 2 + 1, n_b)))
        order = np.argsort(group, kind="stable")
        ids = np.concatenate((ids_a, ids_b))[order]
        sides = np.empty(2 * len(n_a), np.int64)
        sides[0::2], sides[1::2] = n_a, n_b
        ends = np.cumsum(sides) - 1
        mark = np.full(len(ids), 44, np.uint8)
        mark[ends[0::2]], mark[ends[1::2]] = 124, 59
        wide = np.concatenate((self.digits[ids], mark[:, None]), 1)
        size = self.n_digits[ids]
        text = wide[np.arange(5, -1, -1) <= size[:, None]]
        return text, np.cumsum(size + 1)[ends[1::2]]

    def pairs(self, ids_a, ids_b, n_a, n_b, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct pairs of linked ids in order: the text's number, the pair, and how many links it is."""
        links = n_a * n_b
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        some = np.flatnonzero(links <= MANY)
        group, place = _spread(links[some])
        group = some[group]
        width = n_b[group]
        a, b = ids_a[first_a[group] + place // width].astype(np.int64), ids_b[first_b[group] + place % width].astype(np.int64)
        keys = [(text_of[group] << (2 * BITS)) | (a << BITS) | b]
        keys, times = np.unique(keys[0], return_counts=True)
        for g in np.flatnonzero(links > MANY).tolist():
            a, na = np.unique(ids_a[first_a[g] : first_a[g] + n_a[g]].astype(np.int64), return_counts=True)
            b, nb = np.unique(ids_b[first_b[g] : first_b[g] + n_b[g]].astype(np.int64), return_counts=True)
            keys = np.append(keys, (text_of[g] << (2 * BITS)) | ((a[:, None] << BITS) | b).ravel())
            times = np.append(times, np.outer(na, nb).ravel())
        if (links > MANY).any():
            keys, where = np.unique(keys, return_inverse=True)
            times = np.bincount(where, times, len(keys)).astype(np.int64)
        return keys >> (2 * BITS), keys & ((1 << 2 * BITS) - 1), times

    def align(self, batch: pa.RecordBatch, keep_groups: bool) -> pa.RecordBatch:
        ids_a, edges_a, ids_b, edges_b = self.encode(batch.column(1))
        n_a, n_b = self.groups(ids_a, ids_b)
        count = len(batch)
        ends = np.cumsum(n_a)
        text_of = np.searchsorted(edges_a[1:], ends - 1, side="right")
        starts = np.searchsorted(text_of, np.arange(count + 1))
        n_links = np.add.reduceat(np.append(n_a * n_b, 0), starts[:-1]) * (np.diff(starts) > 0)
        text, at = self.told(ids_a, ids_b, n_a, n_b)
        at = np.concatenate(([0], at))[starts]
        raw = text.tobytes()
        told = [raw[x : max(x, y - 1)] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        sha = [hashlib.sha256(x).hexdigest() if x else "" for x in told]
        doc, pair, times = self.pairs(ids_a, ids_b, n_a, n_b, text_of)
        at = np.searchsorted(doc, np.arange(count + 1))
        steps = np.diff(pair, prepend=0)
        steps[at[:-1][at[:-1] < at[1:]]] = pair[at[:-1][at[:-1] < at[1:]]]
        columns = [np.diff(edges_a), np.diff(edges_b), np.diff(starts), n_links]
        groups = pa.array([x.decode() for x in told]) if keep_groups else pa.nulls(count, pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in columns], pa.array(sha), groups, tokens.binaries(steps.astype("<u4"), at), tokens.binaries(times.astype("<u4"), at)],
            [x.split()[0] for x in TEXT.split(", ")],
        )


def read_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places between rows, pairs and times of rows with `pairs` (steps between pairs) and `times`."""
    steps, edges = tokens.flat(batch.column(batch.schema.get_field_index("pairs")))
    times, _ = tokens.flat(batch.column(batch.schema.get_field_index("times")))
    edges = edges // 4
    steps, times = np.ascontiguousarray(steps).view("<u4").astype(np.int64), np.ascontiguousarray(times).view("<u4").astype(np.int64)
    total = np.concatenate(([0], np.cumsum(steps)))
    return edges, total[1:] - np.repeat(total[edges[:-1]], np.diff(edges)), times


def aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """A row per text: its numbers, the digest of its groups (and with keep_groups the groups), its distinct pairs and their times."""

    def run(batches):
        aligner = tokens.kept((path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            for some in tokens.groups(batch, 1, 1_000_000):
                yield aligner.align(some, keep_groups)

    return documents(docs).mapInArrow(run, TEXT)


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, n (texts that hold it), best (whether no pair of its A id has more)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(read_pairs(batch)[1])
            size += len(held[-1])
            if size > 2_000_000:
                pair, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
                held, size = [], 0
        pair, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    n = texts.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.shiftright("pair", BITS)
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most
    return n.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True, head: int = 1 << 19) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with keep_groups the groups."""
    tables = Tables(docs.sparkSession, "alignment")
    texts = tables.keep(aligned(docs, path_a, path_b, keep_groups).withColumn("row", F.monotonically_increasing_id()), "zstd")
    counts = tables.keep(pair_counts(texts))
    # The largest power of two from which on at most `head` pairs have that many texts.
    by_size = {x["k"]: x["pairs"] for x in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).collect()}
    least, total = 64, 0
    while least and total + by_size.get(least - 1, 0) <= head:
        least -= 1
        total += by_size.get(least, 0)
    some = counts.where(F.floor(F.log2("n")) >= least).toArrow().sort_by("pair")
    pairs, numbers = some["pair"].to_numpy(), some["n"].to_numpy()
    best = some["best"].to_numpy() * 1
    base = TEXT.removesuffix(", pairs binary, times binary") + ", row long"

    def sums(batches):
        for batch in batches:
            edges, pair, times = read_pairs(batch)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            at = at * known
            n_best, total = ((np.concatenate(([0], np.cumsum(known * times * x[at] if len(pairs) else known * times))))[edges] for x in (best, numbers))
            rest = np.flatnonzero(~known)
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, edges), pa.int32()), pa.StructArray.from_arrays([pa.array(pair[rest]), pa.array(times[rest])], ["pair", "times"]))
            table = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(np.diff(n_best)), pa.array(np.diff(total)), others], [*table.schema.names, "n_best", "count_sum", "others"])

    found = tables.keep(texts.select(*[x.split()[0] for x in base.split(", ")], "pairs", "times").mapInArrow(sums, base + ", n_best long, count_sum long, others array<struct<pair:long,times:long>>"))
    rare = found.select("row", F.explode("others").alias("x")).select("row", "x.*").join(counts, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = found.drop("others").join(rare, "row", "left")
    out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else []))

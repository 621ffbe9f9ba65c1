"""Repeated byte strings across documents, by suffix arrays of shards.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id
is found. Steps, all distributed:

1. Whole copies: texts are grouped by digest; all but the least document are removed whole.
2. Anchors: in every window of `length` bytes the least hash of its `gram`-byte strings is an anchor
   (winnowing), so two equal windows have equal anchors at the same place. Only windows whose anchor
   occurs in two texts or more can be repeated.
3. Pieces: the run of windows that share an anchor, as one byte string. Equal pieces are one row that
   knows its least document, so groups of copies are never expanded.
4. Shards: pieces go to shards by their anchor. A shard's suffix array comes from induced sorting:
   suffixes are typed L or S, leftmost-S substrings are sorted by inducing and named, the names are
   sorted recursively, and the rest is induced from them in linear scans, vectorised by bucket. Permuted common
   prefixes then show the suffixes that share `length` bytes; the least document of each such group
   decides. Only anchors whose pieces differ need this; a group too large for a shard is split by
   the hash of the window.

Strings are compared on the input. Matches never cross documents, and a string repeated inside one
document alone stays.

Defined cases: a null text is empty; documents with a null doc_id come last, after every number, and
match each other as one document would (they share an id); rows that repeat a doc_id count as one
document likewise and each keeps its row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import _mixed, _Powers
from .shared import Tables, documents
from .tokens import binaries

LAST = (1 << 63) - 1  # a null doc_id among numbers


# -- suffix arrays ------------------------------------------------------------------------------


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _place(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the values, and each one's rank among its equals in that order."""
    order = np.argsort(by, kind="stable")
    ordered = by[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(by) else np.zeros(0, bool)
    at = np.arange(len(by))
    return order, at - np.maximum.accumulate(np.where(new, at, 0))


def _through_runs(suffixes: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """A bucket's suffixes in the order of a scan that starts from these: each round adds the suffixes one letter
    before those of the round before, as far as a run of the bucket's letter goes. What a run adds is an arithmetic
    sequence, so all rounds are placed at once."""
    longer = suffixes - run_start[suffixes]
    if not longer.any():
        return suffixes
    size = longer + 1
    back = np.arange(size.sum()) - np.repeat(_starts(size), size)
    all_of = np.repeat(suffixes, size) - back
    if len(suffixes) == 1:
        return all_of
    key = back.astype(np.uint16) if longer.max() < 1 << 16 else back  # short keys are sorted by radix
    return all_of[np.argsort(key, kind="stable")]


def _induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost-S suffixes, in the order given, induce.

    Buckets are scanned in order, a few array operations each: what a bucket adds to itself are runs of its letter,
    placed by arithmetic; what it adds to others follows in the bucket's order.
    """
    n = len(text)
    heads, ends = _starts(sizes), np.cumsum(sizes)
    array = np.full(n, -1, np.int64)
    run_start = np.maximum.accumulate(np.where(np.concatenate(([True], text[1:] != text[:-1])), np.arange(n), 0)) if n else np.zeros(0, np.int64)
    if len(sizes) < 1 << 16:
        text = text.astype(np.uint16)  # such keys are sorted by radix

    by_letter = lms[np.argsort(text[lms], kind="stable")]
    of_letter = np.bincount(text[by_letter], minlength=len(sizes))
    lms_to = np.cumsum(of_letter)
    lms_from = lms_to - of_letter

    # L from left to right: each bucket's L suffixes stand before its S suffixes.
    free = heads.copy()

    def put(suffixes: np.ndarray, letter: int, want_s: bool, step: int) -> None:
        before = suffixes[suffixes > 0] - 1
        to = text[before]
        leaves = (s_type[before] == want_s) & (to != letter)
        before, to = before[leaves], to[leaves]
        if not len(before):
            return
        order, rank = _place(to)
        before, to = before[order], to[order]
        array[free[to] + step * rank] = before
        count = np.bincount(to, minlength=0)
        free[: len(count)] += step * count

    last = np.array([n - 1]) if n and not s_type[n - 1] else np.zeros(0, np.int64)
    if len(last):  # the last suffix is the least of its letter
        array[free[text[n - 1]]] = n - 1
        free[text[n - 1]] += 1
    used = np.flatnonzero(sizes)
    for c in used.tolist():
        if free[c] > heads[c]:
            now = _through_runs(array[heads[c] : free[c]].copy(), run_start)
            free[c] = heads[c] + len(now)
            array[heads[c] : free[c]] = now
            put(now, c, False, 1)
        put(by_letter[lms_from[c] : lms_to[c]], c, False, 1)
    l_ends = free.copy()

    # S from right to left.
    free = ends - 1
    for c in used[::-1].tolist():
        if free[c] < ends[c] - 1:
            now = _through_runs(array[free[c] + 1 : ends[c]][::-1].copy(), run_start)
            free[c] = ends[c] - 1 - len(now)
            array[free[c] + 1 : ends[c]] = now[::-1]
            put(now, c, True, -1)
        put(array[heads[c] : l_ends[c]][::-1].copy(), c, True, -1)
    return array


def suffix_array(text: np.ndarray, letters: int, stops: bool = False) -> np.ndarray:
    """Suffixes of text (letters 0 to letters - 1) in order; a suffix that ends is less than one that goes on.

    With stops each 0 stands for a letter of its own: suffixes are in order as far as their first 0, and what
    follows it isn't compared (pieces one after another that are much alike would be compared over many of them).
    """
    n = len(text)
    if n < 3 or letters >= n:
        text = np.unique(text, return_inverse=True)[1].astype(np.int64)
        letters = int(text.max()) + 1 if n else 0
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    if letters == n:  # all differ
        out = np.empty(n, np.int64)
        out[text] = np.arange(n)
        return out
    sizes = np.bincount(text, minlength=letters)
    # S: less than the next suffix. Equal letters take the type of the first unequal one; the last is L.
    rise = np.concatenate((np.sign(np.diff(text)), [-1]))
    known = np.where(rise != 0, np.arange(n), n)
    s_type = rise[np.minimum.accumulate(known[::-1])[::-1]] > 0
    lms = np.flatnonzero(s_type & np.concatenate(([False], ~s_type[:-1])))
    if not len(lms):
        return _induce(text, s_type, lms, sizes)
    # Sort leftmost-S substrings by inducing, name them, and sort the string of names.
    first = _induce(text, s_type, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    size = np.diff(np.concatenate((lms, [n])))
    size[:-1] += 1  # with the next one's first letter
    a, b = ordered[:-1], ordered[1:]
    la, lb = size[place[a]], size[place[b]]
    differs = (la != lb) | (place[a] == len(lms) - 1) | (place[b] == len(lms) - 1)
    still, k = np.flatnonzero(~differs), 0
    while len(still) and k < 64:
        unequal = text[a[still] + k] != text[b[still] + k]
        if stops:
            unequal |= text[a[still] + k] == 0
        differs[still[unequal]] = True
        k += 1
        still = still[~unequal & (la[still] > k)]
    for i in still.tolist():  # few are so long, and all of them together no longer than the text
        x, y = text[a[i] + k : a[i] + la[i]], text[b[i] + k : b[i] + la[i]]
        differs[i] = not np.array_equal(x, y) or bool(stops and (x == 0).any())
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.concatenate(([0], np.cumsum(differs)))
    count = int(names.max()) + 1
    if count < len(lms):
        order = _ranked(names, count)
    else:
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
    return _induce(text, s_type, lms[order], sizes)


def _ranked(names: np.ndarray, count: int) -> np.ndarray:
    """Suffixes of the names: recursive induced sorting while the alphabet is small against the text."""
    if count * 16 <= len(names):
        return suffix_array(names, count)
    # Most names are single: buckets hold a suffix or two each, so pairs of ranks are sorted instead, doubling.
    rank, n, k = names.copy(), len(names), 1
    while True:
        second = np.concatenate((rank[k:] + 1, np.zeros(min(k, n), np.int64)))[:n]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def common_prefixes(raw: bytes, array: np.ndarray, most: int) -> np.ndarray:
    """PLCP: for each position of raw, the bytes shared with the suffix before it in the array, up to most; eight at a time."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    out = np.zeros(n, np.int64)
    words = np.ndarray(n + most + 8, "<u8", raw + bytes(most + 16), strides=(1,))
    still = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        differ = words[still + k] ^ words[before[still] + k]
        same = differ == 0
        out[still] = k + np.where(same, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        still = still[same]
        if not len(still):
            break
    return np.minimum(np.minimum(out, most), n - np.maximum(np.arange(n), before))


# -- anchors and pieces -------------------------------------------------------------------------


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each run of width values; one for each start."""
    size = 1
    while 2 * size <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    return least(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


class Hashed:
    """64-bit hashes of any strings of a text: polynomials of their bytes from running sums, then mixed."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _Powers.of(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, gram: int) -> np.ndarray:
        """Of each string of gram bytes, in 63 bits."""
        n = len(self.sums) - gram
        return _mixed((self.sums[gram:] - self.sums[:n]) * self.down[:n]) >> np.uint64(1)


def windows(hashed: Hashed, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: first start, number of starts, the anchor's hash."""
    if len(hashed.sums) <= length:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = hashed.grams(gram)
    least = _slide(h, length - gram + 1, np.minimum)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    first = np.flatnonzero(new)
    return first, np.diff(np.concatenate((first, [len(least)]))), least[first].astype(np.int64)


def _anchors(batches, length: int, gram: int, tasks: int, docs_held: int):
    """The anchors of texts and the texts' keys, packed: a row for each task that a batch has anchors for.

    Of a batch's texts that share an anchor one goes to the anchor's task, where the anchors of other batches meet
    it; the others are known to be shared and are dealt by their text. So a hot anchor adds one place a batch to its task.
    """
    keys, owners, hashes = [], [], []

    def told():
        own, h = np.array(keys, np.int64)[np.concatenate(owners)], np.concatenate(hashes)
        keys.clear(), owners.clear(), hashes.clear()
        order = np.argsort(h, kind="stable")
        own, h = own[order], h[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        single = new & np.concatenate((new[1:], [True])) if len(h) else new
        kind = np.where(single, 0, np.where(new, 1, 2)).astype(np.uint8)
        task = np.where(new, h, own) % tasks
        order = np.argsort(task, kind="stable")
        edges = np.concatenate(([0], np.flatnonzero(np.diff(task[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
        packed = [binaries(x[order], edges) for x in (h, own, kind)]
        return pa.RecordBatch.from_arrays([pa.array(task[order][edges[:-1]], pa.int64()), *packed], ["task", "anchors", "keys", "kinds"])

    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.unique(windows(Hashed(np.frombuffer(raw, np.uint8)), length, gram)[2])
            owners.append(np.full(len(h), len(keys), np.int64))
            hashes.append(h)
            keys.append(key)
            if len(keys) >= docs_held:
                yield told()
    if keys:
        yield told()


def _shared(batches):
    """From the rows of _anchors that a task has: key and anchor, for anchors that two texts have. A task's rows are bounded (see repeats)."""
    held: dict[int, list] = {}
    for batch in batches:
        for task, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            h, own, kind = (np.frombuffer(x, t) for x, t in zip(packed, (np.int64, np.int64, np.uint8), strict=True))
            known = kind == 2
            yield pa.RecordBatch.from_arrays([pa.array(own[known]), pa.array(h[known])], ["key", "anchor"])
            held.setdefault(task, []).append((h[~known], own[~known], kind[~known] == 1))
    for some in held.values():
        h, own, known = (np.concatenate(x) for x in zip(*some, strict=True))
        if len(h):
            order = np.argsort(h, kind="stable")
            h, own, known = h[order], own[order], known[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            several = np.logical_or.reduceat(known, first) | (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first))
            take = np.repeat(several, np.diff(np.append(first, len(h))))
            yield pa.RecordBatch.from_arrays([pa.array(own[take]), pa.array(h[take])], ["key", "anchor"])


PIECES = "key long, doc long, start long, size long, anchor long, piece_id long"


def _pieces(batches, length: int, gram: int):
    """The pieces of each text's shared anchors, without their bytes."""
    for batch in batches:
        keys, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bounds, anchors = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
        out: list[tuple] = []
        for i, raw in enumerate(batch.column(2).to_pylist()):
            hashed = Hashed(np.frombuffer(raw, np.uint8))
            begin, count, marks = windows(hashed, length, gram)
            some = np.sort(anchors[bounds[i] : bounds[i + 1]])
            take = some[np.minimum(np.searchsorted(some, marks), len(some) - 1)] == marks
            begin, size, marks = begin[take], count[take] + length - 1, marks[take]
            out.append((np.full(len(begin), keys[i]), np.full(len(begin), docs[i]), begin, size, marks, hashed(begin, begin + size).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], [x.split()[0] for x in PIECES.split(", ")])


def _sorted_shard(table: pa.Table, length: int) -> pa.Table:
    """The windows of a shard's pieces that a piece with a smaller least document has too, by suffix array."""
    parts, ids, lows, marks = table["piece"].to_pylist(), table["piece_id"].to_numpy(), table["low"].to_numpy(), table["anchor"].to_numpy()
    sizes = np.array([len(x) for x in parts])
    raw = b"".join(x + b"\0" for x in parts)
    text = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0  # below all bytes
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    array = suffix_array(text, 257, stops=True)
    whole = np.arange(len(text)) + length <= ends[owner]  # a window inside its piece
    group = np.cumsum(common_prefixes(raw, array, length)[array] < length) - 1
    group, at = group[whole[array]], array[whole[array]]
    low = np.full(len(text), LAST, np.int64)
    np.minimum.at(low, group, lows[owner[at]])
    at = np.sort(at[low[group] < lows[owner[at]]])
    # Runs of windows side by side are one; the sentinel between pieces keeps theirs apart.
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1))) if len(at) else at
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
    own = owner[first]
    begin = _starts(sizes + 1)[own]
    return pa.table({"anchor": marks[own], "piece_id": ids[own], "from": first - begin, "to": last - begin + length})


def repeats(docs: DataFrame, length: int = 50, gram: int = 24, shard_pieces: int = 20_000, task_anchors: int = 1_500_000, docs_held: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """(names, spans): names has doc_id, key, n_bytes, sha256 (of the text) and copy of every document, spans has
    key and found: the windows to remove of texts that aren't copies as a whole.

    A key is the hash of doc_id and text, so rows that are equal in both share one.
    """
    tables = Tables(docs.sparkSession, "suffixes")
    d = documents(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    names = tables.keep(d.select("doc_id", "doc", "key", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")))
    first = names.where(F.col("n_bytes") >= length).groupBy("sha256").agg(F.min(F.struct("doc", "key")).alias("first"))
    first = tables.keep(first.select("sha256", F.col("first.doc").alias("first_doc"), F.col("first.key").alias("first_key")))
    # An anchor stands in for (length - gram + 2) / 2 bytes: so many tasks that each has about task_anchors of them.
    tasks = int(max(1, (names.agg(F.sum("n_bytes")).first()[0] or 0) // ((length - gram + 2) // 2 * task_anchors)))
    rows = d.select("key", "text").mapInArrow(lambda x: _anchors(x, length, gram, tasks, docs_held), "task long, anchors binary, keys binary, kinds binary")
    shared = rows.repartition(tasks, "task").mapInArrow(_shared, "key long, anchor long")
    shared = shared.groupBy("key").agg(F.collect_list("anchor").alias("anchors"))  # of one text
    # One text of each group of copies from here on.
    shared, shared_at = tables.keep_at(shared.join(first.select(F.col("first_key").alias("key")), "key", "left_semi"))
    tables.release()
    cut = d.join(shared, "key").select("key", "doc", "text", "anchors").mapInArrow(lambda x: _pieces(x, length, gram), PIECES)
    cut, cut_at = tables.keep_at(cut)
    tables.drop(shared_at)
    tables.release()
    # Equal pieces are one, with their least document and one of their places.
    kinds = cut.groupBy("anchor", "piece_id").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), *[F.first(c).alias(c) for c in ("key", "start", "size")])
    kinds, kinds_at = tables.keep_at(kinds)
    # An anchor with one piece alone needs no sorting.
    many = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    places = kinds.join(many, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "piece_id", "low", "n", "start", "size")).alias("some"))
    mixed = d.select("key", "text").join(places, "key").select("text", F.explode("some").alias("x")).select("x.*", F.expr("substring(text, cast(x.start + 1 as int), cast(x.size as int))").alias("piece")).drop("start", "size")
    mixed, mixed_at = tables.keep_at(mixed.dropDuplicates(["anchor", "piece_id"]))
    tables.release()
    shards = max(1, -(-mixed.count() // shard_pieces))
    small = mixed.where(F.col("n") <= shard_pieces).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "piece", "piece_id", "low")
    told = small.groupBy("shard").applyInArrow(lambda x: _sorted_shard(x, length), "anchor long, piece_id long, from long, to long")

    def one_each(batches):
        for batch in batches:
            rows = [(anchor, piece[i : i + length], pid, low, i) for anchor, piece, pid, low in zip(*[c.to_pylist() for c in batch.columns], strict=True) for i in range(len(piece) - length + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 1 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], ["anchor", "piece", "piece_id", "low", "at"])

    # An anchor with more pieces than a shard holds: its windows are dealt by their bytes.
    hot = mixed.where(F.col("n") > shard_pieces).select("anchor", "piece", "piece_id", "low").mapInArrow(one_each, "anchor long, piece binary, piece_id long, low long, at long")
    hot = hot.join(hot.groupBy("anchor", "piece").agg(F.min("low").alias("least")), ["anchor", "piece"]).where("least < low").select("anchor", "piece_id", F.col("at").alias("from"), (F.col("at") + length).alias("to"))
    told = told.unionByName(hot).groupBy("anchor", "piece_id").agg(F.collect_set(F.struct("from", "to")).alias("parts"))
    # A piece is covered whole in documents after its least; in that one, where the shards tell.
    known = kinds.where("low < high").select("anchor", "piece_id", "low").join(told, ["anchor", "piece_id"], "full_outer")
    marked = cut.join(known, ["anchor", "piece_id"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to")))
    marked = marked.select("key", "start", F.explode(F.when(F.col("low") < F.col("doc"), whole).otherwise(F.col("parts"))).alias("x"))
    spans = marked.groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("x.from")).alias("from"), (F.col("start") + F.col("x.to")).alias("to"))).alias("found"))  # of one text
    names = names.join(first, "sha256", "left")
    names = names.select("doc_id", "key", "n_bytes", "sha256", (F.coalesce("first_doc", "doc") < F.col("doc")).alias("copy"), F.coalesce("first_key", "key").alias("first_key"))
    spans = tables.keep(spans)
    for path in (cut_at, kinds_at, mixed_at):
        tables.drop(path)
    tables.release()
    return names, spans


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the spans cover."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1]))
    return first[new], last[np.append(np.flatnonzero(new)[1:], len(first)) - 1]


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 24, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary) of every document."""
    names, spans = repeats(docs, length, gram)

    def run(batches):
        for batch in batches:
            rows, (first, last) = [], (x.to_numpy() for x in batch.column(2).values.flatten())
            bounds = batch.column(2).offsets.to_numpy()
            for i, (key, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = _runs(first[bounds[i] : bounds[i + 1]], last[bounds[i] : bounds[i + 1]])
                kept = b"".join([raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)])
                rows.append((key, len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)], ["key", "removed", "runs", "rest", "kept"])

    d = documents(docs).select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    # Rows that are equal in doc_id and text share a key: one result serves all.
    done = d.join(spans, "key").select("key", "text", "found").mapInArrow(run, "key long, removed long, runs long, rest string, kept binary")
    done = done.groupBy("key").agg(*[F.first(c).alias(c) for c in ("removed", "runs", "rest", "kept")])
    out = names.join(done.withColumnRenamed("key", "first_key"), "first_key", "left")
    whole = F.col("copy")
    cols = {
        "n_removed": F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long"),
        "n_spans": F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long"),
        "kept_sha256": F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("rest", "sha256")),
    }
    out = out.withColumns(cols)
    if not keep_text:
        return out.select("doc_id", "n_bytes", *cols)
    texts = d.groupBy("key").agg(F.first("text").alias("text"))
    kept = F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "text"))
    return out.join(texts, "key").select("doc_id", "n_bytes", *cols, kept.alias("kept"))

"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower-case A-Z). A later line, in the order of doc_id and place,
is removed if an earlier one is equal or has a Jaccard similarity of `num`/`den` or more with it,
whether or not the earlier one is removed itself. Lines without a word stay.

Equal sets are one class with its first place, so copies are never paired. Words are ordered by
rarity (their count, through a table of hashed counts of bounded size, ties by hash); each class is
listed under the words of its prefix, without words that occur once. Under each word the length and
positional filters and one on hashed parities of the words (which can't drop a match) tell the classes
that have a possible partner, then one on more parities; those classes' words are then read and every pair verified, once, under the
least word that it shares. Links are counted where they are found, so no table has a row for each: all links of
a group of near copies count, and tables still don't grow with its square. A word of very many
classes is split into squares of `tile` by `tile` classes, which tasks share.

Words are compared by 55 bits of a hash, equal sets by a sum of 128 bits over their words.

Defined cases: a null or empty text has no lines; a null doc_id stands after all numbers; rows equal
in doc_id and text stand at one place and are judged alike; an empty table gives no rows; extra
columns are ignored or, in dedup_lines, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, documents, lean
from .tokens import binaries

LAST = (1 << 63) - 1
LINES = "doc_id long, doc long, key long, lines array<struct<at:int,hi:long,lo:long,size:int,sign:long,wide:binary,prefix:array<long>>>"


_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray, one: int = 0, two: int = 1) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[one]
    h = (h ^ (h >> np.uint64(27))) * _MIX[two]
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = [np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            cls.up, cls.down = (np.cumprod(x, dtype=np.uint64) for x in steps)
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of raw (A-Z as lower case): 64-bit hash and first byte; and the places of line ends.

    The hash is a polynomial of the bytes modulo 2^64, from running sums over all of raw, then mixed."""
    data = np.frombuffer(raw.lower(), np.uint8)
    blank = np.concatenate(([True], _BLANK[data], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _Powers.of(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * down[starts]), starts, np.flatnonzero(data == 10)


def _joined(texts: list[str], most: int = 500_000):
    """Texts one after another, a line end after each, in parts of about so many bytes: the bytes and their number of texts."""
    parts, size = [], 0
    for text in texts:
        parts.append(text.encode())
        size += len(parts[-1])
        if size >= most:
            yield b"\n".join(parts) + b"\n", parts
            parts, size = [], 0
    if parts:
        yield b"\n".join(parts) + b"\n", parts


#: Buckets whose counts travel in one row, so that a place in it has two bytes.
SLICE = 1 << 16


def _counts(batches, buckets: int, hashed, most: int = 4_000_000):
    """Counts of hashes by bucket, so many hashes at a time: a row for each slice of buckets with the places and counts that aren't zero."""
    held, size = [], 0

    def told():
        n = np.bincount((np.concatenate(held) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        held.clear()
        found = np.flatnonzero(n)
        edges = np.searchsorted(found, np.arange(0, buckets + SLICE, SLICE))
        some = np.flatnonzero(np.diff(edges))
        columns = [pa.array(some.astype(np.int32)), *[binaries(x, edges).take(pa.array(some)) for x in ((found % SLICE).astype("<u2"), n[found].astype("<u4"))]]
        return pa.RecordBatch.from_arrays(columns, ["slice", "at", "n"])

    for batch in batches:
        for h in hashed(batch.column(0).to_pylist()):
            held.append(h)
            size += len(h)
            if size >= most:
                yield told()
                size = 0
    if size:
        yield told()


def _codes(batches):
    """The codes of each slice, from the sum of its counts; a worker holds its slices' sums, `buckets` numbers at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, at, n in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            sums.setdefault(part, np.zeros(SLICE, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    for part, n in sums.items():
        codes = np.where(n < 3, n, np.minimum(255, np.floor(np.log2(np.maximum(n, 1)) * 8) - 9)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([codes.tobytes()])], ["slice", "codes"])


def line_words(texts: list[str]):
    """Hashes of the texts' words, some texts at a time."""
    return (word_hashes(raw)[0] for raw, _ in _joined(texts))


def rarity(docs: DataFrame, buckets: int, hashed=line_words) -> np.ndarray:
    """For each bucket a code that grows with the count of its hashes: 1 for one, 2 for two, then in finer and finer steps of
    logarithms. hashed: the hashes of a list of texts, as arrays."""
    got = docs.select("text").mapInArrow(lean(lambda x: _counts(x, buckets, hashed)), "slice int, at binary, n binary").repartition("slice")
    got = got.mapInArrow(lean(_codes), "slice int, codes binary").toArrow()  # a byte for each bucket
    codes = np.zeros(-(-buckets // SLICE) * SLICE, np.uint8)
    for part, told in zip(*[x.to_pylist() for x in got.columns], strict=True):
        codes[part * SLICE : (part + 1) * SLICE] = np.frombuffer(told, np.uint8)
    return codes[:buckets]


def _sets(raw: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line as keys (rarity, then hash) in ascending order, and their lines' numbers."""
    h, starts, line_ends = word_hashes(raw)
    keys = codes[(h % np.uint64(len(codes))).astype(np.int64)].astype(np.int64) << 55 | (h >> np.uint64(9)).astype(np.int64)
    line = np.searchsorted(line_ends, starts)
    # By key, then (stable) by line; equal keys of a line are one.
    order = np.argsort(keys)
    order = order[np.argsort(line[order].astype(np.uint16 if len(line_ends) < 1 << 16 else np.int64), kind="stable")]
    keys, line = keys[order], line[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    return keys[new], line[new]


def _lines_of(raw: bytes, parts: list[bytes], codes: np.ndarray, num: int, den: int) -> pa.Array:
    """The array of lines of each of the texts in raw (see _joined)."""
    flat, line = _sets(raw, codes)
    lines, starts, n = np.unique(line, return_index=True, return_counts=True)
    last_line = np.cumsum([x.count(b"\n") + 1 for x in parts])
    owner = np.searchsorted(last_line, lines, side="right")
    at = lines - np.concatenate(([0], last_line))[owner]
    per_text = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(parts)))))
    bits = flat.view(np.uint64)
    hi, lo = (np.add.reduceat(_mixed(bits, 2, 1), starts), np.add.reduceat(_mixed(bits, 3, 0), starts)) if len(n) else (bits, bits)
    one, lane = np.left_shift(np.uint64(1), bits & np.uint64(63)), (bits >> np.uint64(6)).astype(np.uint8) % WIDE
    wide = np.stack([np.bitwise_xor.reduceat(one * (lane == i), starts) for i in range(WIDE)], 1) if len(n) else np.zeros((0, WIDE), np.uint64)
    signs = np.bitwise_xor.reduce(wide, axis=1)
    # The prefix, as far as its last word that occurs twice or more; once-words in between leave a hole.
    place = np.arange(len(flat)) - np.repeat(starts, n)
    inside = (place < np.repeat(n - -(-num * n // den) + 1, n)) & np.repeat(n >= num, n)  # smaller sets match their equals alone
    listed = inside & (flat >> 55 > 1)
    length = np.maximum.reduceat(np.where(listed, place + 1, 0), starts) if len(n) else n
    take = place < np.repeat(length, n)
    prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(np.where(listed, flat, -1)[take], pa.int64()))
    columns = [pa.array(at, pa.int32()), *[pa.array(x.view(np.int64)) for x in (hi, lo)], pa.array(n, pa.int32()), pa.array(signs.view(np.int64)), binaries(wide, np.arange(len(n) + 1) * WIDE), prefix]
    return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(columns, ["at", "hi", "lo", "size", "sign", "wide", "prefix"]))


def _classes(docs: DataFrame, codes, num: int, den: int) -> DataFrame:
    """Each document's lines with a word: place, the set's 128-bit hash (a sum over its words), size, sign (its words' hashed
    parities, a bit each), wide (the same in WIDE times as many bits) and prefix. Sets are compared by their words' 55-bit hashes here."""

    def run(batches):
        for batch in batches:
            done = 0
            for raw, parts in _joined(batch.column(3).to_pylist()):
                some = batch.slice(done, len(parts))
                done += len(parts)
                yield pa.RecordBatch.from_arrays([*[some.column(j) for j in range(3)], _lines_of(raw, parts, codes.value, num, den)], ["doc_id", "doc", "key", "lines"])

    return docs.select("doc_id", "doc", "key", "text").mapInArrow(lean(run), LINES)


def _keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return documents(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")


def _squares(batches):
    """Columns word, one, two, part, size, ... of rows (see _tiled) as arrays, some whole squares at a time, by square, then by size."""
    for _, word, one, two, part, size, *others in _whole_groups(batches, 1):
        order = np.lexsort((size, two, one, word))  # hashes of squares may collide
        yield [x.take(pa.array(order)) if isinstance(x, pa.Array) else x[order] for x in (word, one, two, part, size, *others)]


def _whole_groups(batches, keys: int):
    """Columns of rows in the order of their first `keys` columns, as arrays; a group is never cut."""
    held: list[list] = []
    for batch in batches:
        columns = [x if pa.types.is_binary(x.type) or pa.types.is_list(x.type) else x.to_numpy() for x in batch.columns]
        changes = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns[:keys]])) if len(columns[0]) else []
        if held and len(columns[0]) and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], columns, strict=False)):
            yield _together(held)
            held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield _together([*held, [x[:cut] for x in columns]])
            held, columns = [], [x[cut:] for x in columns]
        if len(columns[0]):
            held.append(columns)
    if held:
        yield _together(held)


def _together(held: list[list]) -> list:
    return [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*held, strict=True)]


def _near_pairs(group: np.ndarray, split: np.ndarray, part: np.ndarray, size: np.ndarray, place: np.ndarray, sign: np.ndarray, num: int, den: int):
    """Pairs of rows (i, j) of one group that pass the filters, some at a time; rows stand by group, then by size. In a
    group with split only rows of different parts are paired."""
    at, step = np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        # Sizes ascend in a group: a row whose next one is too large has no partner further on.
        at = at[(group[at] == group[at + step]) & (num * size[at + step] <= den * size[at])]
        if not len(at):
            return
        to = at + step
        both = size[at] + size[to]
        need = -(-num * both // (num + den))
        near = (np.minimum(size[at] - place[at], size[to] - place[to]) >= need) & (~split[at] | (part[at] != part[to]))
        # Words that only one of the two has number at least the bits in which their signs differ.
        near[near] = np.bitwise_count((sign[at[near]] ^ sign[to[near]]).view(np.uint64)) <= (both - 2 * need)[near]
        if near.any():
            yield at[near], to[near]
        step += 1


#: Signs of 64 bits in a wide one: by chance two long lines differ in less of few bits than they may.
WIDE = 4

#: Words of more classes than a square holds are broadcast up to this number, and joined beyond it.
HOT_WORDS = 100_000


def _tiled(rows: DataFrame, counted: DataFrame, tile: int, tables: Tables) -> DataFrame:
    """rows (word, id, ...) with the square (one, two) of its word, a hash of both (a word's first square: the word, twice in a row,
    which shuffles' codec makes short) and the row's part; in order by that hash alone, which Spark sorts by radix.

    counted: rows that may stand under a word of more than `tile` rows."""
    hot = counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("word", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    hot = tables.keep(hot)
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= HOT_WORDS else hot, "word", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")}).drop("parts", "other")
    else:
        rows = rows.withColumns({x: F.lit(0) for x in ("part", "one", "two")})
    square = F.when((F.col("one") == 0) & (F.col("two") == 0), F.col("word")).otherwise(F.xxhash64("word", "one", "two")) if n_hot else F.col("word")
    return rows.withColumn("square", square).repartition("square").sortWithinPartitions("square")


def _groups(word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], (word[1:] != word[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))


ROWS = "word long, id long, size int, place int, sign long"


def _possible(batches, num: int, den: int):
    """The rows (see _tiled) that have a partner by the filters. With prefixes and wide signs: one that shares no word before
    theirs, so that each pair is left under one word alone, and passes by its wide sign as well."""
    for word, one, two, part, size, id_, place, sign, *prefix in _squares(batches):
        group, found = _groups(word, one, two), np.zeros(len(word), bool)
        if prefix:
            wide = np.frombuffer(b"".join(prefix[1].to_pylist()), np.uint64).reshape(-1, WIDE)
            flat, row = prefix[0].flatten().to_numpy(), np.repeat(np.arange(len(word)), prefix[0].value_lengths().to_numpy())
            early = (flat >= 0) & (flat < word[row])
            width, start, bits, *_ = _bitsets(group, flat[early], row[early])
        for i, j in _near_pairs(group, one != two, part, size, place, sign, num, den):
            if prefix:
                both = size[i] + size[j]
                near = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64) <= both - 2 * -(-num * both // (num + den))
                i, j = i[near], j[near]
                if not len(i):
                    continue
                shared = np.zeros(len(i), bool)
                for k in range(int(width[i].max())):
                    on = np.flatnonzero(width[i] > k)
                    shared[on] |= (bits[start[i[on]] + k] & bits[start[j[on]] + k]) != 0
                i, j = i[~shared], j[~shared]
            found[i] = found[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (word, id_, size, place, sign)], ["word", "id", "size", "place", "sign"])


def _bitsets(group: np.ndarray, flat: np.ndarray, row: np.ndarray):
    """Rows' keys (flat, of the rows in row) as sets of bits: by row the number of 64-bit words and the first of them, the
    words; then keys, rows and columns. A group's keys that two rows have are its columns, in ascending order; -1 for others."""
    order = np.lexsort((flat, group[row]))
    flat, row = flat[order], row[order]
    new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (group[row[1:]] != group[row[:-1]]))) if len(flat) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(flat))) > 1
    owner = group[row[first[several]]]
    before = np.searchsorted(owner, np.arange(group[-1] + 2))
    columns = np.full(len(first), -1)
    columns[several] = np.arange(len(owner)) - before[owner]
    column = columns[np.cumsum(new) - 1] if len(flat) else columns
    width = (np.diff(before) + 63 >> 6)[group]
    start = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), np.uint64)
    take = column >= 0
    np.bitwise_or.at(bits, start[row[take]] + (column[take] >> 6), np.uint64(1) << (column[take] & 63).astype(np.uint64))
    return width, start, bits, flat, row, column


def _linked(batches, num: int, den: int):
    """Of the rows (see _tiled) that have links under their word: id, the number of links and the least first place of a partner.

    A pair counts where the least column of both is the group's own word.
    """
    for word, one, two, part, size, id_, place, sign, doc, key, at, keys in _squares(batches):
        group = _groups(word, one, two)
        width, start, bits, flat, row, column = _bitsets(group, np.frombuffer(b"".join(keys.to_pylist()), np.int64), np.repeat(np.arange(len(word)), size))
        own = np.full(len(word), -1)  # the column of the group's word
        mine = (column >= 0) & (flat == word[row])
        own[row[mine]] = column[mine]
        rank = np.empty(len(word), np.int64)
        by_first = np.lexsort((at, key, doc))
        rank[by_first] = np.arange(len(word))
        links, least = np.zeros(len(word), np.int64), np.full(len(word), len(word))
        for i, j in _near_pairs(group, one != two, part, size, place, sign, num, den):
            common, early = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
            for k in range(int(width[i].max())):
                on = np.flatnonzero(width[i] > k)
                both = bits[start[i[on]] + k] & bits[start[j[on]] + k]
                common[on] += np.bitwise_count(both)
                ahead = np.clip(own[i[on]] - 64 * k, 0, 64)
                mask = np.where(ahead >= 64, np.uint64((1 << 64) - 1), (np.uint64(1) << np.minimum(ahead, 63).astype(np.uint64)) - np.uint64(1))
                early[on] |= (both & mask) != 0
            good = ~early & (den * common >= num * (size[i] + size[j] - common))
            i, j = i[good], j[good]
            links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
            np.minimum.at(least, i, rank[j])
            np.minimum.at(least, j, rank[i])
        some = np.flatnonzero(links)
        partner = by_first[least[some]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id_[some], links[some], doc[partner], key[partner], at[partner])], ["id", "n_links", "doc", "key", "at"])


def _links(classes: DataFrame, classes_at: str, docs: DataFrame, codes, tables: Tables, num: int, den: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """id, n_links and near (the least first place of a linked class) of every class with links; and the classes without their
    prefixes, in place of the table at classes_at."""
    listed = classes.select("id", F.posexplode("prefix").alias("place", "word"), "size", "sign").where("word >= 0")
    code = F.shiftrightunsigned("word", 55)  # from the word's count in all lines, see rarity
    tiled = _tiled(listed, listed.where(code >= int(np.floor(np.log2(8 * tile) * 8)) - 9), 8 * tile, tables)
    first = ["square", "word", "one", "two", "part", "size", "id", "place", "sign"]
    some, some_at = tables.keep_at(tiled.select(*first).mapInArrow(lean(lambda x: _possible(x, num, den)), ROWS).distinct())
    tables.release()
    tiled = _tiled(some.join(classes.select("id", "prefix", "wide"), "id"), some, 4 * tile, tables)
    possible, possible_at = tables.keep_at(tiled.select(*first, "prefix", "wide").mapInArrow(lean(lambda x: _possible(x, num, den)), ROWS).distinct())
    classes = tables.keep(classes.select("id", "hi", "lo", "n", "first"))
    for path in (some_at, classes_at):
        tables.drop(path)
    tables.release()

    # The words of the lines where those classes stand first.
    wanted = classes.join(possible.select("id").distinct(), "id").groupBy("first.key").agg(F.collect_list(F.struct("id", "first.at")).alias("wanted"))
    parts = docs.select("key", "text").join(wanted, "key").select(F.split("text", "\n").alias("parts"), F.explode("wanted").alias("w"))
    parts = parts.select("w.id", F.get("parts", F.col("w.at")).alias("line")).dropDuplicates(["id"])  # rows may repeat

    def words(batches):
        for batch in batches:
            flat, line = _sets(b"\n".join(x.encode() for x in batch.column(1).to_pylist()) + b"\n", codes.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(flat, np.searchsorted(line, np.arange(batch.num_rows + 1)))], ["id", "keys"])

    keyed, keyed_at = tables.keep_at(parts.mapInArrow(lean(words), "id long, keys binary"))
    tables.release()
    tiled = _tiled(possible.join(classes.select("id", "first.*"), "id").join(keyed, "id"), possible, tile, tables)
    found = tiled.select(*first, "doc", "key", "at", "keys").mapInArrow(lean(lambda x: _linked(x, num, den)), "id long, n_links long, doc long, key long, at int")
    found = tables.keep(found.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc", "key", "at")).alias("near")))
    for path in (possible_at, keyed_at):
        tables.drop(path)
    tables.release()
    return found, classes


def matches(docs: DataFrame, num: int = 4, den: int = 5, buckets: int = 1 << 23, tile: int = 1024) -> DataFrame:
    """doc_id, key, n_lines (with a word), removed (places of the lines to remove, from 0 in order) and n_links (links of
    its lines' classes with other classes, over all its lines) of every document."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "lines")
    d = _keyed(docs)
    codes = spark.sparkContext.broadcast(rarity(d, buckets))  # a byte for each bucket
    lines, lines_at = tables.keep_at(_classes(d, codes, num, den))
    each = lines.select("doc", "key", F.explode("lines").alias("x")).select("doc", "key", "x.*")
    classes = each.groupBy("hi", "lo").agg(F.min(F.struct("doc", "key", "at")).alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sign").alias("sign"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix"))
    classes, classes_at = tables.keep_at(classes.withColumn("id", F.monotonically_increasing_id()))
    # Prefixes are kept once, and no longer than they are read.
    lines = tables.keep(lines.select("doc_id", "doc", "key", F.transform("lines", lambda x: F.struct(x.at.alias("at"), x.hi.alias("hi"), x.lo.alias("lo"))).alias("lines")))
    tables.drop(lines_at)
    tables.release()
    each = lines.select("doc", "key", F.explode("lines").alias("x")).select("doc", "key", "x.*")
    found, classes = _links(classes, classes_at, d, codes, tables, num, den, tile)
    told = classes.select("id", "hi", "lo", "n", "first").join(found, "id", "left").where("n > 1 or n_links > 0").select("hi", "lo", F.least("first", F.coalesce("near", "first")).alias("least"), "n_links")
    gone = F.when(F.col("least") < F.struct("doc", "key", "at"), F.col("at"))
    seen = each.select("doc", "key", "at", "hi", "lo").dropDuplicates(["key", "at"]).join(told, ["hi", "lo"])
    seen = seen.groupBy("key").agg(F.array_sort(F.collect_list(gone)).alias("removed"), F.sum("n_links").alias("n_links"))  # one document's lines
    out = lines.select("doc_id", "key", F.size("lines").cast("long").alias("n_lines")).join(seen, "key", "left")
    return out.select("doc_id", "key", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def dedup_lines(docs: DataFrame, text_col: str = "text", num: int = 4, den: int = 5, buckets: int = 1 << 23) -> DataFrame:
    """docs with the later matches taken out of their texts; a document whose every line with a word
    goes is dropped, one that had none stays."""
    found = matches(docs.select("doc_id", F.col(text_col).alias("text")), num, den, buckets).groupBy(F.col("key").alias("_lines_key")).agg(F.first("removed").alias("_lines_removed"), F.first("n_lines").alias("_lines_n"))
    same = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_lines_key")
    d = docs.join(found, same).where("_lines_n = 0 or size(_lines_removed) < _lines_n")
    kept = F.expr(f"array_join(filter(split({text_col}, '\\n'), (x, i) -> not array_contains(_lines_removed, i)), '\\n')")
    return d.withColumn(text_col, F.when(F.size("_lines_removed") > 0, kept).otherwise(F.col(text_col))).select(*docs.columns)

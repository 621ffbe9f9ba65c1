"""SimHash near-duplicates by multi-index hashing.

Fingerprints that differ in at most `bits` bits are linked. The 64 bits are cut into segments; by
the pigeonhole principle a pair within `bits` agrees on some segment up to that segment's radius.
The table holds each distinct fingerprint under its segments; a fingerprint asks for every key in
the small Hamming ball around each of its segments, and whole distances are verified in the join.
Documents with one fingerprint are one row there, so copies are never paired; a fingerprint can
have at most sum(C(64, i), i <= bits) partners, whatever the size of a group.

Defined cases: a null or blank text has the fingerprint 0 and is linked like any other; fewer words
than a shingle make one shingle; a null doc_id is kept and never a component's name unless all are
null; repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .lines import _bitsets, _groups, _mixed, _near_pairs, _squares, _tiled, rarity, word_hashes
from .shared import Tables, documents, lean

#: A byte's bits as 8 lanes of one byte, so that up to 255 rows add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: str, n_words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the words, lower-case A-Z, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n_words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, h = (ends - sizes)[: len(words) - n_words + 1].tolist(), xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[n_words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    lanes = LANES[hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)]
    counts = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """doc_id, fp (long) of every document."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(x, n_words)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents(docs).mapInArrow(lean(run), "doc_id long, fp long")


def segments(bits: int, n_segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius): with bits = n * r + a, the first a + 1 segments have the radius r, the others r - 1."""
    r, a = divmod(bits, n_segments)
    edges = [64 * i // n_segments for i in range(n_segments + 1)]
    return [(low, high - low, r if i <= a else r - 1) for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)) if i <= a or r > 0]


def _ball(width: int, radius: int) -> list[int]:
    """The masks of at most `radius` of `width` bits."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(width), r)]


def links(fps: DataFrame, bits: int = 2, n_segments: int = 2) -> DataFrame:
    """a, b: every pair of distinct fingerprints (column fp, distinct) within `bits`.

    A segment's radius is shared: the table holds the ball of its lesser half, the question asks for the other's.
    """
    table, asked = [], []
    for i, (low, width, radius) in enumerate(segments(bits, n_segments)):
        key = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for side, r in ((table, radius // 2), (asked, radius - radius // 2)):
            side += [F.struct(F.lit(i).alias("segment"), key.bitwiseXOR(F.lit(x)).alias("key")) for x in _ball(width, r)]
    left = fps.select(F.col("fp").alias("a"), F.explode(F.array(*asked)).alias("k")).select("a", "k.*")
    right = fps.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("k")).select("b", "k.*")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    found = left.join(right, (left.segment == right.segment) & (left.key == right.key) & near)
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, n_words: int = 3, bits: int = 2, n_segments: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach) of every document."""
    tables = Tables(docs.sparkSession, "simhash")
    marked = tables.keep(fingerprints(docs, n_words))
    classes = tables.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), bits, n_segments), tables)
    named = classes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = tables.keep(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _sets_of(ids: DataFrame, docs: DataFrame, unique: DataFrame, n_words: int) -> DataFrame:
    """id and shingles (64-bit keys) of the texts in ids (id, distinct); unique: id, text_hash and doc_id of each
    different text of docs."""
    wanted = unique.join(ids, "id").select("id", F.col("text_hash").alias("hash"), F.col("doc_id").alias("doc"))

    def sets(batches):
        for batch in batches:
            found = [shingle_keys(x, n_words).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    # One row a text, whatever its copies, but for repeated rows, which give the same links.
    texts = docs.withColumn("text_hash", F.md5("text")).join(wanted, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("id", "text")
    return texts.mapInArrow(lean(sets), "id long, shingles array<long>")


def _alike(pairs: DataFrame, docs: DataFrame, unique: DataFrame, tables: Tables, n_words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets of word shingles have a Jaccard similarity of num/den or more. For lists of pairs that
    grow with the texts; see _joining for those that grow with the square of a group."""
    pairs = tables.keep(pairs)
    found, found_at = tables.keep_at(_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, unique, n_words))
    tables.release()

    both = pairs.join(found.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = tables.keep(both.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b"))
    tables.drop(found_at)
    tables.release()
    return out


ROOTED = "word long, id long, size int, place int, root long"


def _common(bits: np.ndarray, start: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of keys that rows i and j, of one group each, have in common (see _bitsets)."""
    out, on = np.zeros(len(i), np.int64), np.flatnonzero(width[i])
    if len(on):
        n = width[i[on]]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        both = bits[np.repeat(start[i[on]], n) + step] & bits[np.repeat(start[j[on]], n) + step]
        out[on] = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first)
    return out


def _partners(batches, num: int, den: int):
    """The rows (see _tiled) that have a partner of another root by the filters. With prefixes: one that shares no key before
    theirs, so that each pair is left under one key alone."""
    for word, one, two, part, size, id_, place, root, *prefix in _squares(batches):
        group, found = _groups(word, one, two), np.zeros(len(word), bool)
        if prefix:
            flat, row = prefix[0].flatten().to_numpy(), np.repeat(np.arange(len(word)), prefix[0].value_lengths().to_numpy())
            early = flat < word[row]
            width, start, bits, *_ = _bitsets(group, flat[early], row[early])
        for i, j in _near_pairs(group, one != two, part, size, place, np.zeros(len(word), np.int64), num, den):
            good = root[i] != root[j]
            i, j = i[good], j[good]
            if prefix:
                good = _common(bits, start, width, i, j) == 0
                i, j = i[good], j[good]
            found[i] = found[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (word, id_, size, place, root)], ["word", "id", "size", "place", "root"])


def _forest(batches, num: int, den: int):
    """Of the rows (see _tiled): links (a, b) that connect what all links of a square connect, fewer than its rows. Pairs that
    others connect already aren't compared."""
    for word, one, two, part, size, id_, place, root, shingles in _squares(batches):
        group = _groups(word, one, two)
        width, start, bits, *_ = _bitsets(group, shingles.flatten().to_numpy(), np.repeat(np.arange(len(word)), size))
        # Rows of one root in a group are one from the start; up leads from a row to one of its set.
        order = np.lexsort((root, group))
        new = np.concatenate(([True], (group[order[1:]] != group[order[:-1]]) | (root[order[1:]] != root[order[:-1]])))
        up = np.empty(len(word), np.int64)
        up[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        links: list[tuple[int, int]] = []
        for i, j in _near_pairs(group, one != two, part, size, place, np.zeros(len(word), np.int64), num, den):
            apart = up[i] != up[j]
            i, j = i[apart], j[apart]
            common = _common(bits, start, width, i, j)
            good = den * common >= num * (size[i] + size[j] - common)
            for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((a, b))
            if good.any():
                while (up[up] != up).any():
                    up = up[up]
        ends = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(id_[x]) for x in ends.T], ["a", "b"])


def _joining(shared: DataFrame, docs: DataFrame, unique: DataFrame, tables: Tables, n_words: int, num: int, den: int, tile: int) -> DataFrame:
    """a, b: links that connect what all links between texts of different roots connect; shared: key, id, size, place and root of
    the prefixes' shingles. Pairs are verified in squares of texts under the least key of both, and no table has a row for each."""
    rows = shared.select(F.col("key").alias("word"), "id", "size", "place", "root")
    columns = ["square", "word", "one", "two", "part", "size", "id", "place", "root"]
    some = tables.keep(_tiled(rows, rows, 8 * tile, tables).select(*columns).mapInArrow(lean(lambda x: _partners(x, num, den)), ROOTED).distinct())
    tables.release()
    prefixes = some.groupBy("id").agg(F.collect_list("word").alias("prefix"))
    tiled = _tiled(some.join(prefixes, "id"), some, 4 * tile, tables).select(*columns, "prefix")
    possible = tables.keep(tiled.mapInArrow(lean(lambda x: _partners(x, num, den)), ROOTED).distinct())
    tables.release()
    sets = tables.keep(_sets_of(possible.select("id").distinct(), docs, unique, n_words).dropDuplicates(["id"]))
    tables.release()
    tiled = _tiled(possible.join(sets, "id"), possible, tile, tables).select(*columns, "shingles")
    return tables.keep(tiled.mapInArrow(lean(lambda x: _forest(x, num, den)), "a long, b long"))


def _keys(h: np.ndarray, n_words: int) -> np.ndarray:
    """A 64-bit key of each shingle, repeats included, from hashes of the words; 0 alone for no words."""
    k = min(n_words, len(h))
    if not k:
        return np.zeros(1, np.uint64)
    keys = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return _mixed(keys)


def shingle_keys(text: str, n_words: int) -> np.ndarray:
    """A 64-bit key of each different shingle of the words (lower-case A-Z)."""
    return np.unique(_keys(word_hashes(text.encode())[0], n_words))


def _marked(docs: DataFrame, codes, n_words: int, num: int, den: int, fingerprint_words: int, simhash_words: int | None) -> DataFrame:
    """doc_id, text_hash (MD5), fp (over shingles of fingerprint_words), simhash (operator 4's, over simhash_words; null without), size and
    prefix of each text's set of shingles (rarity, then 55 bits of the key, in ascending order): two sets alike at num/den have a shingle
    of both prefixes in common."""

    def run(batches):
        for batch in batches:
            fps, marks, sizes, found = [], [], [], []
            for x in batch.column(2).to_pylist():
                h = word_hashes(x.encode())[0]
                fps.append(fingerprint(_keys(h, fingerprint_words)))
                marks.append(fingerprint(shingle_hashes(x, simhash_words)) if simhash_words else None)
                keys = np.unique(_keys(h, n_words))
                n = len(keys)
                code = codes.value[(keys % np.uint64(len(codes.value))).astype(np.int64)].astype(np.int64)
                sizes.append(n)
                found.append(np.sort(code << 55 | (keys >> np.uint64(9)).astype(np.int64))[: n - -(-num * n // den) + 1])
            columns = [pa.array(fps, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "fp", "simhash", "size", "prefix"])

    return docs.select("doc_id", F.md5("text").alias("text_hash"), "text").mapInArrow(lean(run), "doc_id long, text_hash string, fp long, simhash long, size int, prefix array<long>")


def _by_simhash(unique: DataFrame, tables: Tables, bits: int, n_segments: int) -> DataFrame:
    """a, b: links of ids that connect what operator 4 connects; unique: id and simhash of each different text."""
    classes = tables.keep(unique.groupBy(F.col("simhash").alias("fp")).agg(F.min("id").alias("least")))
    near = links(classes.select("fp"), bits, n_segments)
    between = near.join(classes.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    within = unique.join(classes, unique.simhash == classes.fp).where("least < id")
    out = tables.keep(between.select(F.col("x").alias("a"), F.col("y").alias("b")).union(within.select(F.col("least").alias("a"), F.col("id").alias("b"))))
    tables.release()
    return out


def near_duplicate_groups(docs: DataFrame, n_words: int = 5, num: int = 4, den: int = 5, bits: int = 8, n_segments: int = 3, fingerprint_words: int = 2, buckets: int = 1 << 20, tile: int = 512, simhash: tuple[int, int, int] | None = None) -> DataFrame:
    """doc_id, text_hash (MD5) and first (the least doc_id of its group) of every document.

    Texts are linked if their sets of n_words-word shingles have a Jaccard similarity of num/den or
    more, and groups are what links connect. Equal texts are one. First each text is tried with the
    least one under each segment of its fingerprint (over shorter shingles, within `bits` bits), and
    with the least one under each shingle of its prefix; most of a large group of near copies is
    connected by then. All pairs that have a shingle of their prefixes in common and aren't connected
    yet are verified next, so no link that could join two groups is left out; they are told and verified
    inside squares of `tile` by `tile` texts, which only tell what they connect. With simhash (n_words,
    bits, n_segments), texts are linked as well if operator 4 links their fingerprints, however alike.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "near")
    d = documents(docs)

    codes = spark.sparkContext.broadcast(rarity(d, buckets, lambda texts: (shingle_keys(x, n_words) for x in texts)))  # a byte for each bucket
    full, full_at = tables.keep_at(_marked(d, codes, n_words, num, den, fingerprint_words, simhash and simhash[0]))
    marked = tables.keep(full.select("doc_id", "text_hash"))
    unique = full.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), *[F.first(x).alias(x) for x in ("fp", "simhash", "size", "prefix")])
    unique, unique_at = tables.keep_at(unique.withColumn("id", F.monotonically_increasing_id()))
    sets = unique.select("id", "size", "prefix")
    unique = tables.keep(unique.select("id", "text_hash", "doc_id", "fp", "simhash"))
    tables.drop(full_at)
    tables.release()

    # By fingerprints: the least text under each segment.
    keys = [F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for i, (low, width, _) in enumerate(segments(bits, n_segments))]
    listed = unique.select("id", "fp", F.explode(F.array(*keys, F.struct(F.lit(-1).alias("segment"), F.col("fp").alias("key")))).alias("k")).select("id", "fp", "k.*")
    least = listed.groupBy("segment", "key").agg(F.min(F.struct("id", "fp")).alias("m"), F.count("*").alias("n")).where("n > 1").select("segment", "key", "m")
    star = listed.join(least, ["segment", "key"]).where((F.col("m.id") < F.col("id")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("m.fp"))) <= bits))
    star = star.select(F.col("m.id").alias("a"), F.col("id").alias("b"))

    # By shingles: the least text under each of the prefix, then all that aren't connected.
    shared = sets.select("id", "size", F.posexplode("prefix").alias("place", "key"))
    least = shared.groupBy("key").agg(F.min(F.struct("id", "size", "place")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m")
    least = tables.keep(least)
    tables.release()
    shared = tables.keep(shared.join(least, "key"))
    tables.drop(unique_at)
    tables.release()

    def near(size, place, other_size, other_place):
        need = F.ceil(num * (size + other_size) / (num + den))  # shingles in common
        return (num * size <= den * other_size) & (num * other_size <= den * size) & (F.least(size - place, other_size - other_place) >= need)

    first = shared.where((F.col("m.id") < F.col("id")) & near(F.col("size"), F.col("place"), F.col("m.size"), F.col("m.place"))).select(F.col("m.id").alias("a"), F.col("id").alias("b"))
    close = _alike(star.union(first).distinct(), d, unique, tables, n_words, num, den)
    if simhash:
        close = tables.keep(close.union(_by_simhash(unique.select("id", "simhash"), tables, *simhash[1:])))
    roots = components(close, tables)
    shared = shared.drop("m").join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = shared.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    shared = tables.keep(shared.join(several, "key"))
    tables.release()
    far = _joining(shared, d, unique, tables, n_words, num, den, tile)
    roots = components(close.union(far), tables)
    named = unique.join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("first"))
    named = tables.keep(named.join(first, "root").select("text_hash", "first"))
    return marked.select("doc_id", "text_hash").join(named, "text_hash").select("doc_id", "text_hash", "first")


def one_of_each(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group of near duplicates, by operator 4's links and by shingles in common, the one
    with the least doc_id. Of rows that share it, or when all have none, one stays for each different text."""
    found = near_duplicate_groups(docs.select("doc_id", F.col(text_col).alias("text")), **{"simhash": (3, 2, 2)} | how)
    stay = found.where(F.col("first").isNull() | (F.col("doc_id") == F.col("first"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_hash"))
    return docs.join(stay, same, "left_semi").dropDuplicates(["doc_id", text_col])


def hex_of(fp):
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

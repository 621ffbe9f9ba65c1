"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import os
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerspark.llm import graph, hmm, licences, lines, media, mixing, packing, quality, simhash, suffixes, tokens, wavelet
from ledgerspark.llm.queries import BYTE_BPE as BYTE
from ledgerspark.llm.queries import WORD_BPE as WORD
from ledgerspark.llm.shared import Tables

SCHEMA = "doc_id long, text string, source string, fp long, key long, word string"
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "sé", "or") for b in ("ra", "n", "st", "", "que", "it")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)

    def prose(n):
        return " ".join(rng.choice(VOCABULARY) + (".\n" if rng.random() < 0.08 else "") for _ in range(n))

    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    passage = prose(40)
    texts += [texts[3], texts[3], texts[5].replace("ka", "KA"), texts[7] + " extra", passage + " " + prose(30), prose(20) + " " + passage, None, "", "  \n ", "one", "two words", prose(3000), "x" * 300, "日本 語 \U0001f600 ok"]
    return [(i, t, [None, "a", "b", "c"][i % 4], 1, 2, "w") for i, t in enumerate(texts)] + [(None, texts[0], "a", 1, 2, "w"), (3, texts[3], "c", 1, 2, "w")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


ODD = ["a   b\n \n c  ", "\n\n x", "\xa0a\xa0b \x1c c", "it's  don't 12ab ab12, é́ <|endoftext|> x", " ", "a .. b,c. d's. ab'", "x" * 4000, "É ΑΣ ΣΣ İ ß ǅ"]


@pytest.mark.parametrize("path, kind", [(BYTE, "byte"), (WORD, "word")])
def test_parts_have_the_ids_of_whole_texts(path, kind, rows):
    coder, texts = tokens.Pieces(path, kind), ODD + [r[1] or "" for r in rows] + ["a  ", "", "b", "  ", " c", "\u3000d \u3000e \x85 f  \xa0g"]
    ids, edges = coder.encode(pa.array(["left out", *texts]).slice(1))
    for i, text in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == ids_of(path, text, 0)[:-1], text[:50]
    assert coder.encode(pa.array(["", ""]))[1].tolist() == [0, 0, 0]


def test_packing(spark, docs, rows, empty):
    window = 64
    packed = packing.pack(docs, BYTE, "byte", window=window, docs_per_shard=20)
    got = packed.collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        want = ids_of(BYTE, text, 0)
        mine = sorted((r for r in pieces[doc_id]), key=lambda r: r.start)
        assert {r.doc_tokens for r in mine} >= {len(want)}
        for r in mine:
            if r.doc_tokens == len(want):
                assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want[r.start : r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
    assert sum(r.length for r in got) == sum(len(ids_of(BYTE, t, 0)) for _, t, *_ in rows)
    whole = defaultdict(list)
    for r in got:
        whole[r.sequence_id].append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    made = packing.sequences(packed, window).collect()
    assert all(len(r.input_ids) == window or len(r.input_ids) == r.n_tokens and not r.n_tokens & (r.n_tokens - 1) for r in made)
    assert packing.pack(empty, BYTE).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    numbers, offsets = packing.best_fit(sizes, 100)
    room: list[int] = []
    for size, number, offset in zip(sizes, numbers, offsets, strict=True):
        fit = [r for r in room if r >= size]
        if fit:
            assert room[number] == min(fit)
        else:
            assert number == len(room)
            room.append(100)
        assert offset == 100 - room[number]
        room[number] -= size


def test_wavelet_files(spark, docs, rows, empty):
    got = wavelet.token_files(docs, WORD, "word", end_id=2, docs_per_shard=15, block_tokens=200).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in ordered:
        ids = np.array(ids_of(WORD, text, 2), "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got], key=lambda r: r[1]) == want
    assert wavelet.token_files(empty, WORD).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_wavelet_matrix(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 300).astype(np.uint32)
    m = wavelet.Matrix.build(ids, 9)
    assert m.all().tolist() == ids.tolist()
    if n:
        assert m.access(np.arange(n)).tolist() == ids.tolist()
        for p in (0, 8):
            bits = np.unpackbits(m.words[p].view(np.uint8), bitorder="little", count=n)
            assert m.rank1(p, np.arange(n + 1)).tolist() == np.concatenate(([0], np.cumsum(bits))).tolist()
            for bit in (0, 1):
                assert m.select(p, bit, np.arange(int((bits == bit).sum()))).tolist() == np.flatnonzero(bits == bit).tolist()
    for x in (0, 1, 7, 299, 5000):
        assert m.count(x) == int((ids == x).sum()) and m.count(x, n // 2) == int((ids[: n // 2] == x).sum())
        assert m.occurrences(x).tolist() == np.flatnonzero(ids == x).tolist()


def test_wavelet_width():
    with pytest.raises(ValueError):
        wavelet.Matrix.build(np.array([70_000], np.uint32), 16)
    assert wavelet.Matrix.build(np.array([70_000], np.uint32), 17).all().tolist() == [70_000]


def plain_lines(rows):
    """doc_id, places of removed lines, number of lines and of links of each different row, by brute force."""
    places = sorted({((r[0] if r[0] is not None else lines.LAST, xxhash.xxh64_intdigest(str(r[1]).encode())), r[0], r[1] or "") for r in rows}, key=lambda x: x[0])
    found = [(p, d, i, frozenset(x.encode().lower().split())) for p, d, t in places for i, x in enumerate(t.split("\n")) if x.split()]
    first = {}
    for p, _, i, s in [*found, *found]:
        first.setdefault(s, (p, i))
    links = {s: [o for o in first if o != s and 5 * len(s & o) >= 4 * len(s | o)] for s in first}
    want = set()
    for p, d, _ in places:
        mine = [(i, s) for q, _, i, s in found if q == p]
        gone = tuple(i for i, s in mine if min([first[s]] + [first[o] for o in links[s]]) < (p, i))
        want.add((d, gone, len(mine), sum(len(links[s]) for _, s in mine)))
    return want


def test_line_matches(docs, rows, empty):
    got = {(r.doc_id, tuple(r.removed), r.n_lines, r.n_links) for r in lines.matches(docs, buckets=1 << 12).collect()}
    assert got == plain_lines(rows)
    assert lines.matches(empty, buckets=64).count() == 0
    kept = lines.dedup_lines(docs, buckets=1 << 12)
    assert kept.columns == docs.columns and kept.count() < docs.count() and kept.where("text is null").count() == 1
    assert lines.dedup_lines(empty, buckets=64).count() == 0


def test_lines_of_a_large_group_of_near_copies(spark):
    """All links between the different lines of a group, its word split into squares, among other lines with shared words."""
    rng, rows = random.Random(7), []
    base = [f"b{i}" for i in range(30)]
    for i in range(180):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(30)] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(line) + "\n" + " ".join(rng.choice(base[:6] + VOCABULARY[:9]) for _ in range(rng.randint(1, 9)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (7, 1024):
        got = {(r.doc_id, tuple(r.removed), r.n_lines, r.n_links) for r in lines.matches(frame, buckets=1 << 12, tile=tile).collect()}
        assert got == plain_lines(rows)
    assert sum(x[3] for x in got) > 10_000


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bits, n_segments", [(2, 2), (3, 2), (4, 3), (8, 3)])
def test_simhash(docs, rows, empty, bits, n_segments):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, 3, bits, n_segments).collect())
    fps = [plain_fingerprint(r[1], 3) for r in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    want = sorted((r[0] if r[0] is not None else -1, fp, min((q[0] for q, h in zip(rows, group, strict=True) if h == g and q[0] is not None), default=None)) for r, fp, g in zip(rows, fps, group, strict=True))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_are_found_and_others_stay(spark):
    """Recall against brute force, on copies with edited words; never a document without a partner."""
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(6000)]
    rows, no = [], 0
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for c in range(4):
            edited = list(base)
            for _ in range(0 if c == 0 else rng.randint(0, max(1, len(base) // 60))):
                edited[rng.randrange(len(edited))] = f"e{no}"
            rows.append((no, " ".join(edited)))
            no += 1
    got = {r.doc_id: r.first for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    close = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(close) > 100 and sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close)
    partners = {x for p in close for x in p}
    assert all(got[i] == i for i in sets if i not in partners)
    stay = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert stay == len(set(got.values()))


def near_groups(rows):
    """Each document's least partner's number through links at 0.8 or more, and the links, by brute force."""
    sets = {i: shingles(t) for i, t in rows}
    close = [(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = {i: i for i in sets}
    for a, b in close:
        low, high = sorted((group[a], group[b]))
        if low != high:
            group = {i: low if g == high else g for i, g in group.items()}
    return group, close


def test_near_duplicate_chains(spark):
    """A ~ B ~ C with A not ~ C, in each order of doc_ids: links of a text that has found its partner count too."""
    rng, rows = random.Random(3), []
    for order in [(0, 1, 2), (1, 0, 2), (0, 2, 1), (2, 1, 0), (1, 2, 0), (2, 0, 1)] * 3:
        base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
        links = [base, base[:60] + [f"x{rng.randint(0, 9999)}" for _ in range(6)] + base[66:], None]
        links[2] = links[1][:10] + [f"y{rng.randint(0, 9999)}" for _ in range(6)] + links[1][16:]
        rows += [(len(rows) + i, " ".join(links[k])) for i, k in enumerate(order)]
    rows += [(1000, ""), (1001, " \n"), (1002, "one two"), (1003, "One  two")]
    want, close = near_groups([r for r in rows if r[0] < 1000])
    assert len(close) == 36 and all(want[3 * i + j] == 3 * i for i in range(18) for j in range(3))
    got = {r.doc_id: r.first for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), buckets=1 << 10).collect()}
    assert got == want | {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002}


def test_near_duplicates_by_replaced_cut_and_appended_passages(spark):
    """Every group of texts alike at 0.8 or more is found, whatever was changed, down to exactly 0.8."""
    rng, rows = random.Random(12), []
    for i in range(150):
        n = rng.randint(60, 300)
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        share = (n - 4) / 5 if i % 2 else (n - 4) * rng.uniform(0.12, 0.22)
        m, fresh = int(share), [f"v{rng.randint(0, 5000)}" for _ in range(n)]
        at = rng.randint(0, n - m)
        edited = [base[:at] + fresh[: max(1, m // 2 - 4)] + base[at + max(1, m // 2 - 4) :], base[: n - m], base + fresh[: m + m // 5]][i % 3]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    base = [f"z{i}" for i in range(104)]
    rows += [(900, " ".join(base)), (901, " ".join(base[:84]))]  # 80 of 100 shingles
    want, close = near_groups(rows)
    assert (900, 901) in close and all(sum(a // 2 % 3 == k for a, _ in close) > 20 for k in range(3))
    got = {r.doc_id: r.first for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_edge_cases(docs, empty, rows):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns and out.count() < len(rows)
    assert simhash.one_of_each(empty).count() == 0


def test_components(spark):
    tables = Tables(spark, "test")
    path = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 201), (400, 400)], "a long, b long")
    got = {r.v: r.root for r in graph.components(path, tables).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200, 300: 200, 400: 400}
    assert graph.components(path.limit(0), tables).count() == 0


def test_mixing(docs, rows, empty, spark):
    for shard_words in (1_000_000, 500):
        got = mixing.mix(docs, block=4, shard_words=shard_words).collect()
        sizes, taken, target = Counter(), Counter(), {}
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size
        assert sizes == Counter({s: sum(len((t or "").encode().split()) for _, t, x, *_ in rows if x == s) for s in ("a", "b", "c", None)})
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight, want, open_ = dict(zip(order, [3, 1, 2, 3], strict=True)), {}, set(order)
        while True:
            rest = 1.5 * sum(sizes.values()) - sum(want.values())
            level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if level[s] > 2 * sizes[s]}
            if not over:
                want |= level
                break
            want |= {s: 2.0 * sizes[s] for s in over}
            open_ -= over
        for s in order:
            assert math.isclose(target[s], want[s]) and abs(taken[s] - want[s]) <= max(4 * 20, 0.02 * want[s])
        again = mixing.mix(docs.repartition(7), block=4, shard_words=shard_words).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs, block=4)
    assert mixed.columns == docs.columns
    words = sum(len(r.text.encode().split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix(docs, block=4).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def plain_base(text):
    words = [w for w in (text or "").encode().split()]
    chars = sum(len(w.decode()) for w in words)
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(i, i + 5))
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality(spark, docs, rows, empty):
    rep = "a b c d e f g h i j k l\n" * 3 + "q # * x"
    more = spark.createDataFrame([(900, rep, "a", 1, 2, "w"), (901, "same line here\nsame line here\n\n\nother $$", "a", 1, 2, "w")], SCHEMA)
    d = docs.unionByName(more)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    buckets = 512
    got = quality.quality(d, labels, buckets=buckets).collect()
    texts = [(r[0], r[1]) for r in rows] + [(r.doc_id, r.text) for r in more.collect()]

    def grams(text):
        w = (text or "").encode().split()
        h = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, a) for a, b in zip(h, w[1:], strict=False)]
        return [((x + (1 << 63)) % (1 << 64) - (1 << 63)) % buckets for x in h + two]

    raw, target = Counter(), Counter()
    parts = {(r.doc_id, r.part) for r in quality.labelled(labels, 20_000).collect()}
    good = {i for i, p in parts if p == "target"}
    assert {i for i, p in parts if p in ("target", "good")} == {i for i in range(30) if i % 3 > 0 and i != 1} and {i for i, p in parts if p == "bad"} == {i for i in range(30) if i % 3 == 0}
    scores = {p: [r.score for r in got if (r.doc_id, p) in parts and r.doc_id != 3 and not r.base_failed] for p in ("good", "bad")}
    for i, t in texts:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def score(t):
        g = grams(t)
        share = [(raw[x] + 1) / (n_raw + buckets) for x in g]
        return sum(math.log((target[x] + buckets * s) / (n_target + buckets)) - math.log(s) for x, s in zip(g, share, strict=True)) / len(g) if g else None

    want = sorted(str((i, *plain_base(t), round(score(t), 6) if grams(t) else None)) for i, t in texts)
    assert sorted(str((r.doc_id, *[r[c] for c in quality.BASE], None if r.score is None else round(r.score, 6))) for r in got) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= r.threshold)
        assert r.threshold <= min(scores["good"]) and all(x <= r.threshold or x >= min(scores["good"]) for x in scores["bad"])
    kept = quality.kept_documents(d, labels, buckets=buckets)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality(empty, labels.limit(0)).count() == 0
    assert quality.quality(docs, labels.limit(0)).where("kept").count() > 0


def test_quality_counts_and_threshold_use_all_labelled_rows(spark):
    """Over 20,000 rows of each part: all of the target are counted, all others fit the threshold."""
    n, buckets = 90_000, 16
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 9 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    target = labels.where((F.col("quality") == 1) & (F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(2)) == 0)).count()
    assert target > 20_000 and quality.labelled(labels).count() == n
    got = quality.ratios(docs, labels, buckets).collect()
    share = (n + 1) / (n + buckets)
    assert len(got) == 1 and math.isclose(got[0].ratio, math.log((target + buckets * share) / (target + buckets)) - math.log(share), rel_tol=1e-9)

    def scored(last):
        turned = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) * (F.col("doc_id") + 1) / 1000.0
        return docs.select("doc_id", F.lit(False).alias("base_failed"), F.when(F.col("doc_id") < last, turned).otherwise(F.floor("doc_id") % 7 + 0.5).alias("score"))

    parts = quality.labelled(labels)
    for last, lost in ((n, 0.001), (n, 0.5), (0, 0.3)):
        rows = scored(last).join(parts, "doc_id").collect()
        good = sorted(r.score for r in rows if r.part == "good")
        low = good[max(1, math.ceil(lost * len(good))) - 1]
        below = max((r.score for r in rows if r.part == "bad" and r.score < low), default=low - 0.1)
        assert quality.fitted(scored(last), parts, lost).first().threshold == (low + below) / 2


def test_hmm_base_and_totals(docs, rows, empty, spark):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = hmm.score(docs, held, states=3, head=20, lookup=25).collect()

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    counts = Counter()
    for i, t, *_ in rows:
        if not out(i):
            counts.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        want.append(str((i, out(i), len(words), sum(w in counts for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 4))))
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(empty, held).count() == 0
    assert hmm.score(docs, F.lit(True)).count() == len(rows)


def test_hmm_recursions():
    rng = np.random.default_rng(3)
    m = hmm.Model.of(rng.random(2) * 5, rng.random((2, 2)) * 5, rng.random((2, 4)) * 5)
    runs = [np.array(x, np.uint16) for x in ([0], [1, 2, 3], [3, 0, 0, 1, 2])]
    for run, got in zip(runs, m.log10(runs), strict=True):
        total = sum(np.prod([m.start[p[0]] * m.emit[p[0], run[0]], *[m.step[a, b] * m.emit[b, x] for a, b, x in zip(p, p[1:], run[1:], strict=False)]]) for p in __import__("itertools").product(range(2), repeat=len(run)))
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)
    start, step, emit = m.expect(runs)
    assert math.isclose(start.sum(), 3, rel_tol=1e-4) and math.isclose(step.sum(), 6, rel_tol=1e-4) and math.isclose(emit.sum(), 9, rel_tol=1e-4)
    before = m.log10(runs).sum()
    assert hmm.Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)).log10(runs).sum() >= before - 1e-6


@pytest.mark.parametrize("n, stretch", [(5, 2), (64, 16), (65, 16), (1000, 7), (300, 300), (300, 400)])
def test_hmm_stretches_of_a_long_text(n, stretch):
    rng = np.random.default_rng(n)
    m = hmm.Model.of(rng.random(3) * 5, rng.random((3, 3)) * 5, rng.random((3, 6)) ** 4 * 50)
    text = rng.integers(0, 6, n).astype(np.uint16)
    assert math.isclose(m.log10_long(text, stretch), m.log10([text])[0], rel_tol=1e-9)
    for got, want in zip(m.expect_long(text, stretch, 3 * stretch), m.expect([text]), strict=True):
        assert np.allclose(got, want, rtol=2e-3, atol=1e-4)
    runs = [text[:0], text]
    s = hmm.anchored(np.concatenate(runs).astype(np.int64), 3, np.array([0, n]))
    step = np.zeros((3, 3))
    np.add.at(step, (s[:-1], s[1:]), 1)
    start, got, emit = hmm.anchored_long(text, 3, 6, piece=11)
    assert start[s[0]] == 1 and np.array_equal(got, step) and emit.sum() == n and np.array_equal(emit.sum(1), np.bincount(s, minlength=3))


def test_hmm_text_of_a_million_words():
    rng = np.random.default_rng(5)
    m = hmm.Model.of(rng.random(7), rng.random((7, 7)), rng.random((7, 1000)))
    text = rng.integers(0, 1000, 1_000_001).astype(np.uint16)
    tracemalloc.start()
    start, step, emit = m.expect_long(text, 2048, 100_000)
    told = m.log10_long(text, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and math.isclose(start.sum(), 1, rel_tol=1e-3) and math.isclose(step.sum(), 1e6, rel_tol=1e-3) and math.isclose(emit.sum(), 1e6 + 1, rel_tol=1e-3)
    assert math.isclose(told, m.log10([text])[0], rel_tol=1e-9)


def test_slices_keep_words():
    for text in ("", " ", "a b  c\td\u00a0e\x1ff " * 50, "x" * 300, " " * 300, "ab " * 7 + "x" * 90 + "\n"):
        assert [w for part in hmm.slices(text, 10) for w in hmm.words_of(part)] == hmm.words_of(text)


def plain_hmm(texts, training, states, head, rounds):
    """log10 of each text's probability by a plain Baum-Welch over whole texts, with the operator's beginning and smoothing."""
    words = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    counts = Counter(w for i in training for w in words[i])
    ids = {w: i + 1 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:head])}
    ids.setdefault(b" ", len(ids) + 1)
    size = len(ids) + 1
    coded = [[ids.get(w, 0) for w in x] for x in words]
    start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
    for i in training:
        anchors, state = [x for x in coded[i] if 1 <= x <= states], []
        for x in coded[i]:
            state.append((x if 1 <= x <= states else state[-1] + 1 if state else anchors[0] if anchors else 1) - 1)
        start[state[0]] += 1
        for a, b in zip(state, state[1:], strict=False):
            step[a, b] += 1
        for a, x in zip(state, coded[i], strict=True):
            emit[a, x] += 1
    model = hmm.Model.of(start, step, emit)
    for _ in range(rounds):
        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
        for i in training:
            x = coded[i]
            ahead, back = [model.start * model.emit[:, x[0]]], [np.ones(states)]
            for y in x[1:]:
                ahead.append(ahead[-1] / ahead[-1].sum() @ model.step * model.emit[:, y])
            for y in reversed(x[1:]):
                b = model.step @ (model.emit[:, y] * back[0])
                back.insert(0, b / b.sum())
            for t, y in enumerate(x):
                gamma = ahead[t] * back[t] / (ahead[t] @ back[t])
                emit[:, y] += gamma
                start += gamma * (t == 0)
                if t:
                    both = ahead[t - 1][:, None] * model.step * (model.emit[:, y] * back[t])
                    step += both / both.sum()
        model = hmm.Model.of(start, step, emit)
    other = Counter({w: n for w, n in counts.items() if w not in ids})
    out = []
    for x, w in zip(coded, words, strict=True):
        now, total = None, 0.0
        for y in x:
            now = (model.start if now is None else now @ model.step) * model.emit[:, y]
            total += math.log10(now.sum())
            now = now / now.sum()
        out.append(total + sum(math.log10((other[v] + 1) / (sum(other.values()) + len(other) + 1)) for v, y in zip(w, x, strict=True) if y == 0))
    return out


def test_hmm_training_counts_whole_texts(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(VOCABULARY[6 * (j // 20 % 6) : 6 * (j // 20 % 6) + 6]) for j in range(n)) for n in (1, 30, 300, 700, 1500, 40, 0)] + [None, "unknown words"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in hmm.score(frame, F.col("doc_id").isin(3, 8), states=3, head=20, batch_tokens=500, cut=600, stretch=50).collect()}
    want = plain_hmm(texts, [i for i in range(len(texts)) if i not in (3, 8)], 3, 20, 2)
    assert all(math.isclose(got[i], x, rel_tol=2e-4) for i, x in enumerate(want))


def test_hmm_beats_single_words(spark):
    rng = random.Random(4)
    langs = [[f"{p}{i}" for i in range(40)] for p in "abcd"]
    data = [(i, " ".join(rng.choice(langs[i % 4]) for _ in range(60))) for i in range(200)]
    got = hmm.score(spark.createDataFrame(data, "doc_id long, text string"), F.col("doc_id") % 5 == 0, states=6, head=300).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_licences(spark, empty):
    mit = "Copyright (c) 2020 Someone\r\n\r\n" + licences.KNOWN[0][1].replace("copyright holders", "Copyright Owners").replace(", ", " ,\n")
    rows = [(1, mit), (2, "Some words\n  Released under the MIT Licence!\nmore\nLICENSED UNDER CC BY-NC 4.0"), (3, None), (4, ""), (None, "SPDX-License-Identifier: ISC"), (5, "MIT")]
    got = {r.doc_id: (r.text_license, r.n_license_lines, r.line_licenses) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 0, ""), 2: (None, 2, "MIT,CC-BY-NC-4.0"), 3: (None, 0, ""), 4: (None, 0, ""), None: ("ISC", 1, "ISC"), 5: (None, 0, "")}
    assert licences.scan(empty).count() == 0
    clash = spark.createDataFrame([(1, "MIT", "x", 5, None), (1, "MIT", "x", 5, None), (2, "word " * 200_000 + "\nAll rights reserved.", None, 1, "y")], "doc_id long, text string, row string, u long, digest string")
    assert [(r.doc_id, r.n_license_lines) for r in licences.scan(clash).orderBy("doc_id").collect()] == [(1, 0), (1, 0), (2, 1)]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_full_licence_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {x: open(f"/usr/share/common-licenses/{x}", encoding="utf-8").read() for x in files}
    rows = [(x, "  Copyright (c) 2021 Some One\n" + t.upper().replace("\n", "\r\n").replace("LICENSE", "LICENCE")) for x, t in texts.items()] + [("GPL-3 cut", texts["GPL-3"][:-900])]
    got = {r.name: r.text_license for r in licences.scan(spark.createDataFrame(rows, "name string, text string").selectExpr("xxhash64(name) as doc_id", "text", "name")).join(spark.createDataFrame([(x,) for x, _ in rows], "name string").selectExpr("name", "xxhash64(name) as doc_id"), "doc_id").collect()}
    assert got == files | {"GPL-3 cut": None}


def plain_repeats(rows, length):
    low, texts = {}, [(suffixes.LAST if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    for d, _, b in texts:
        for i in range(len(b) - length + 1):
            low[b[i : i + length]] = min(d, low.get(b[i : i + length], d))
    out = []
    for d, name, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if low[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append(str((name, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"shard_pieces": 3, "docs_held": 5, "task_anchors": 50}, {"docs_held": 2}])
def test_repeated_strings(docs, rows, empty, how, monkeypatch):
    plain = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda d, length, gram: plain(d, length, gram, **how))
    for length, gram in ((50, 24), (20, 8)):
        got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixes.remove_repeats(docs, length, gram).collect())
        assert got == plain_repeats(rows, length)
    kept = suffixes.remove_repeats(docs).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)
    assert suffixes.remove_repeats(empty).count() == 0


def test_anchor_records_do_not_grow_with_tasks(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["key", "text"])
    packed = [[sum(len(x) for c in ("anchors", "keys", "kinds") for x in b[c].to_pylist()) for b in suffixes._anchors([batch], 50, 24, n, 5)] for n in (1, 1000)]
    assert packed[0] == packed[1]


def test_suffix_arrays():
    rng = random.Random(1)
    for n, letters in [(0, 3), (1, 2), (2, 2), (5, 2), (50, 2), (200, 3), (300, 1), (1000, 4), (3000, 40), (5000, 2)]:
        text = np.array([rng.randrange(letters) for _ in range(n)], np.int64)
        array = suffixes.suffix_array(text, letters)
        plain = text.tolist()
        assert array.tolist() == sorted(range(n), key=lambda i: plain[i:])
        raw = text.astype(np.uint8).tobytes()
        shared = suffixes.common_prefixes(raw, array, 30) if n else []
        for a, b in zip(array[:-1].tolist(), array[1:].tolist(), strict=True):
            k = 0
            while k < 30 and max(a, b) + k < n and raw[a + k] == raw[b + k]:
                k += 1
            assert shared[b] == k


def test_suffix_arrays_with_runs():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.randint(1, 4)
        plain = [x for _ in range(rng.randint(1, 12)) for x in [rng.randrange(letters)] * rng.choice([1, 1, 2, 5, 17])]
        assert suffixes.suffix_array(np.array(plain, np.int64), letters).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    # As many letters as the alphabet could hold, not all different.
    plain = [rng.randrange(1, 4) for _ in range(257)]
    assert suffixes.suffix_array(np.array(plain, np.int64), 257).tolist() == sorted(range(257), key=lambda i: plain[i:])


def test_suffix_array_of_very_long_runs():
    for letters in ([7], [7, 9]):
        text = np.concatenate([np.resize(letters, 2_000_000), [0], np.resize(letters, 2_000_000), [0]]).astype(np.int64)
        began = time.process_time()
        array = suffixes.suffix_array(text, 257, stops=True)
        assert time.process_time() - began < 30
        assert np.array_equal(np.sort(array), np.arange(len(text)))
        assert np.all(np.diff(text[array]) >= 0)
        # Of suffixes with the same first letter, the one with fewer letters before its 0 comes first.
        left = np.where(np.arange(len(text)) <= 2_000_000, 2_000_000, len(text) - 1) - np.arange(len(text))
        for x in letters:
            assert np.all(np.diff(left[array[text[array] == x]]) >= 0)


def test_repeated_strings_of_long_runs(spark):
    docs = spark.createDataFrame([(1, "a" * 3_000_000 + "b"), (2, "a" * 3_000_001), (3, "x" + "a" * 49), (4, "b" + "a" * 50 + "b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs, keep_text=False).collect()}
    assert got == {1: (3_000_001, 0, 0), 2: (3_000_001, 3_000_001, 1), 3: (50, 0, 0), 4: (52, 51, 1)}


def test_suffix_arrays_of_pieces():
    rng = random.Random(2)
    piece = [rng.randrange(1, 4) for _ in range(30)]
    pieces = [[x if rng.random() < 0.97 else 3 for x in piece[rng.randrange(5) :]] for _ in range(60)]
    text = np.array([x for p in pieces for x in [*p, 0]], np.int64)
    plain, array = text.tolist(), suffixes.suffix_array(text, 4, stops=True).tolist()
    assert sorted(array) == list(range(len(plain)))
    cut = [tuple(plain[i : plain.index(0, i)]) for i in array]
    assert cut == sorted(cut)


def test_image_copies(spark):
    rng = np.random.default_rng(9)

    def picture(h, w):
        return np.kron(rng.integers(0, 255, (h, w)), np.ones((6, 6))).astype(np.uint8)

    one, two, three = picture(16, 16), picture(20, 12), picture(16, 16)
    made = [one, one[18:, 10:], np.clip(one * 0.7 + 30, 0, 255).astype(np.uint8), two, three, one.copy(), np.rot90(two)]
    rows = [(i, int(x.shape[1]), np.ascontiguousarray(x).tobytes(), "extra") for i, x in enumerate(made)] + [(50, 0, b"", ""), (51, None, None, ""), (None, 10, b"123", "")]
    images = spark.createDataFrame(rows, "image_id long, width int, pixels binary, digest string")
    got = {r.image_id: r.class_id for r in media.copies(images).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 0, 3, 4, 0, 3] and got[50] == 50 and got[51] == 50 and got[None] is None
    assert media.copies(images.limit(0)).count() == 0
    assert media.render(None) == (96, b"") and media.render("<p>a b<script>x y</script><p>c")[1] == media.render("<div>a b</div>c")[1]


def plain_image_links(corners, votes, bits, cell):
    """(a, b) of the images (id: corners) for which enough corners of b vote for one shift, turn and scale."""
    out = set()
    for a, b in combinations(sorted(corners), 2):
        told = defaultdict(set)
        for ox, oy, os, ot, obits in corners[a]:
            for x, y, s, t, h in corners[b]:
                if ((h ^ obits) & (1 << 64) - 1).bit_count() <= bits:
                    turn, angle, size = (t - ot) % media.TURNS, ((t - ot) % media.TURNS) * (2 * np.pi / media.TURNS), 2.0 ** (s - os)
                    dx, dy = x - size * (np.cos(angle) * ox - np.sin(angle) * oy), y - size * (np.sin(angle) * ox + np.cos(angle) * oy)
                    for g in (0, 1):
                        told[turn, s - os, g, math.floor(dx / cell + g / 2), math.floor(dy / cell + g / 2)].add((x, y, s, t))
        if any(len(v) >= votes for v in told.values()):
            out.add((a, b))
    return out


def test_image_links_are_all_found(spark, monkeypatch):
    """Images whose common keys are shared out over earlier images, whose other halves differ, and with a descriptor many times over."""
    rng = random.Random(6)
    made = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    place = [(20 * i % 300, 35 * i % 280, 0, i % media.TURNS) for i in range(40)]
    whole = [(*place[i], made[i]) for i in range(12)]
    images = {i: [(*place[j], made[j]) for j in range(3 * i, 3 * i + 3)] + [(rng.randrange(300), rng.randrange(300), 0, 0, rng.getrandbits(64) - (1 << 63)) for _ in range(8)] for i in range(4)}
    images[4], images[5] = whole, [(x + 40, y + 7, s, t, h ^ (i % 2)) for i, (x, y, s, t, h) in enumerate(whole)]
    # One half of the descriptor alike, the other not, in an earlier image than the two that match.
    images[6] = [(*place[i], made[i] ^ 0b111 << 40) for i in range(20, 30)]
    images[7], images[8] = [(*place[i], made[i]) for i in range(20, 30)], [(place[i][0], place[i][1] + 9, *place[i][2:], made[i]) for i in range(20, 30)]
    # A descriptor at many corners of each image; the third has them elsewhere.
    lattice = [(30 + 20 * (i % 5), 30 + 20 * (i // 5), 0, 3, made[35]) for i in range(20)]
    images[9], images[10] = lattice, [(x + 60, y, s, t, h) for x, y, s, t, h in lattice]
    images[11] = [(rng.randrange(3000), rng.randrange(3000), 0, rng.randrange(16), made[35]) for _ in range(20)]
    for i in range(12, 30):
        images[i] = [(rng.randrange(60), rng.randrange(60), rng.randrange(2), rng.randrange(3), made[30 + rng.randrange(5)]) for _ in range(rng.randint(0, 15))]
    rows = [(i, str(i), c) for i, c in images.items()]
    frame = spark.createDataFrame(rows, "image_id long, digest string, corners array<struct<x:int,y:int,scale:int,turn:int,bits:long>>").repartition(1).orderBy("image_id")
    monkeypatch.setattr(media, "descriptors", lambda _: frame)
    got = {r.image_id: (r.class_id, r.n_links) for r in media.copies(frame).collect()}
    links = plain_image_links(images, 6, 1, 12)
    assert {(4, 5), (7, 8), (9, 10)} <= links and not {(a, b) for a, b in links if a < 4 or a == 6 or b == 6}
    group = {i: i for i in images}
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = {i: low if g == high else g for i, g in group.items()}
    assert got == {i: (group[i], sum(i in p for p in links)) for i in images}
    monkeypatch.setattr(media, "IMAGES", 3, raising=False)
    monkeypatch.setattr(media, "MATCHES", 400, raising=False)
    assert got == {r.image_id: (r.class_id, r.n_links) for r in media.copies(frame).collect()}


def test_each_dedup_stage_of_the_pipeline_has_an_effect(spark, tmp_path):
    """A near copy goes as a document, and lines that other documents share go from the rest."""
    import corpus_pipeline

    rng = random.Random(4)
    rows = [[" ".join(f"w{rng.randint(0, 9999)}" for _ in range(12)) for _ in range(20)] for _ in range(2)]
    copy = [*rows[0][:9], "a line of its own", *rows[0][10:]]
    rows = [(0, rows[0]), (1, copy), (2, [*rows[1], rows[0][3]])]
    docs = spark.createDataFrame([(i, "\n".join(x), "en", "s0", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert seen[0] != seen[1] != seen[2]
    assert seen[2] == {0: "\n".join(rows[0][1]), 2: "\n".join(rows[2][1][:-1])}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice(VOCABULARY)}{rng.randint(0, 99)}" for _ in range(80)) + "\nand " + rng.choice(VOCABULARY), "en", f"s{i % 3}", 10) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 10) for i in range(10)] + [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, "short text", "en", "s0", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert 200 not in counts[0] and 202 not in counts[0] and set(range(60)) <= counts[0]
    assert not counts[1] & set(range(100, 110)) and set(range(60)) <= counts[1]
    assert counts[2] <= counts[1]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == counts[3]

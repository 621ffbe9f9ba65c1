"""Packing by matching, token alignment and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import alignment, packing, pairing, spelling
from ledgerspark.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  \n ", "a", "tab\tand  spaces   ", "<|endoftext|> plain <|endoftext|>  <|startoftext|>x", "don't stop", "▁ mark", "ﬁ ẞ é", "\U0001f600" * 50, "中文 no space 中", "<s> <0x0A> </s>", "x" * 3000]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, length int")


def real_texts(spark, n=60):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


# -- packing by matching ------------------------------------------------------------------------


def plain_ids(tokenizer, text, end_id):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]


def test_matched_packing_keeps_every_id_and_few_windows(spark):
    texts = [*ODD, *real_texts(spark), "the cat " * 3000, *["same text of some words"] * 40]
    rows = pairing.pack_matched(docs_of(spark, texts), BYTE_BPE, "byte", bucket_size=16).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    pieces, windows = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids, got = plain_ids(tokenizer, text, 2), sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert b"".join(r["ids"] for r in got) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert [r["start"] for r in got] == [sum(x["length"] for x in got[:k]) for k in range(len(got))]
        assert len(got) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in got[1:])
    for some in windows.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(windows) <= -(-sum(r["length"] for r in rows) // 1024) + 2
    again = pairing.pack_matched(docs_of(spark, texts).repartition(5), BYTE_BPE, "byte", bucket_size=16)
    assert sorted(map(tuple, again.drop("ids").collect())) == sorted(map(tuple, (r[:5] + r[6:] for r in rows)))


def greedy(lengths, window):
    """The same rules, a piece at a time: large ones with the longest partner that fits, then the tightest gap."""
    large, gaps = sorted((x for x in lengths if 3 * x > window), reverse=True), []
    while large:
        size = large.pop(0)
        mate = next((x for x in large if x <= window - size), None)
        if mate is not None:
            large.remove(mate)
        gaps.append(window - size - (mate or 0))
    for size in sorted((x for x in lengths if 3 * x <= window), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is None:
            gaps.append(window - size)
        else:
            gaps[gaps.index(fit)] = fit - size
    return gaps


@pytest.mark.parametrize("seed", range(60))
def test_plan_by_counts_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 30, 64, 100])
    lengths = [rng.choice([rng.randint(1, window), rng.randint(1, max(1, window // 4)), window // 2, window // 3]) or 1 for _ in range(rng.randint(0, 200))]
    plan = pairing.Plan(dict(Counter(lengths)), window)
    held = {}
    ends = {}
    for size, first_rank, first, each, offset in plan.runs:
        ends.setdefault(size, []).append(first_rank)
    for size, first_rank, first, each, offset in plan.runs:
        later = [x for x in ends[size] if x > first_rank]
        for nth in range(min(later, default=lengths.count(size)) - first_rank):
            held.setdefault(first + nth // each, []).append((offset + nth % each * size, size))
    gaps = []
    for some in held.values():
        at = 0
        for offset, size in sorted(some):
            assert offset == at
            at += size
        gaps.append(window - at)
    assert sum(map(len, held.values())) == len(lengths)
    assert sorted(gaps) == sorted(greedy(lengths, window)) and len(gaps) == plan.windows


def test_matched_packing_of_nothing_and_sequences(spark):
    assert pairing.pack_matched(docs_of(spark, []), BYTE_BPE).count() == 0
    packed = pairing.pack_matched(docs_of(spark, ["a b c", None]), BYTE_BPE)
    (row,) = packing.sequences(packed).collect()
    assert row["n_tokens"] == 5 and len(row["input_ids"]) == 1024


@pytest.mark.parametrize("path,kind", [(BYTE_BPE, "byte"), (WORD_BPE, "word")])
def test_special_strings_are_what_the_library_makes_of_them(path, kind):
    import pyarrow as pa

    from ledgerspark.llm.tokens import Pieces

    rng, bits = random.Random(3), ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "a", "the", "\n", "'t", ".", "é", "12", "中"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    for plain in (False, True):
        tokenizer = Tokenizer.from_file(path)
        if plain:
            tokenizer.encode_special_tokens = True
        ids, edges = Pieces(path, kind, plain).encode(pa.array(texts))
        for text, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# -- alignment ----------------------------------------------------------------------------------


def byte_of():
    """The byte that each character of a byte-level entry stands for: printable ones themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def plain_groups(texts):
    a, b, back = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), byte_of()
    a.encode_special_tokens = True
    out = []
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(bytes_a) == whole == b"".join(bytes_b):
            at_a = at_b = 0
            group = ([], [])
            ids_a, ids_b = list(zip(ids_a, map(len, bytes_a), strict=True)), list(zip(ids_b, map(len, bytes_b), strict=True))
            while ids_a or ids_b:
                if at_a <= at_b:
                    i, n = ids_a.pop(0)
                    group[0].append(i)
                    at_a += n
                else:
                    i, n = ids_b.pop(0)
                    group[1].append(i)
                    at_b += n
                if at_a == at_b:
                    groups.append(group)
                    group = ([], [])
        out.append(groups)
    return out


@pytest.mark.parametrize("head", [1 << 19, 8, 0])
def test_alignment_equals_plain_groups_and_counts(spark, head):
    rng = random.Random(5)
    bits = ["<|endoftext|>", " ", "   ", "the", "ing", "\n", "\t", "don't", ".,", "é", "中文", "\U0001f600", "2024", "Q" * 9, "▁", "<0x0A>"]
    texts = [*ODD, *real_texts(spark, 40), *["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(60)], "same", "same"]
    groups = plain_groups(texts)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(pair for x in links for pair in x)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    got = {r["doc_id"]: r for r in alignment.align(docs_of(spark, texts), BYTE_BPE, PIECE_BPE, head=head).collect()}
    assert len(got) == len(texts)
    for i, (g, x) in enumerate(zip(groups, links, strict=True)):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want = {
            "doc_id": i, "n_a": sum(len(a) for a, _ in g), "n_b": sum(len(b) for _, b in g), "n_groups": len(g), "n_links": sum(x.values()),
            "n_best": sum(n for p, n in x.items() if held[p] == most[p[0]]), "count_sum": sum(n * held[p] for p, n in x.items()),
            "groups_sha256": hashlib.sha256(told.encode()).hexdigest() if told else "", "groups": told,
        }
        assert got[i].asDict() == want
    assert sum(map(bool, groups)) > 50 and not all(groups)


def test_groups_of_many_links_are_counted_whole(monkeypatch, spark):
    texts = [*real_texts(spark, 20), "ab" * 500]
    whole = alignment.align(docs_of(spark, texts), BYTE_BPE, PIECE_BPE, keep_groups=False)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(alignment, "MANY", 1)
    aligner = alignment.Aligner(BYTE_BPE, PIECE_BPE)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    few = alignment.read_pairs(aligner.align(batch, False))
    monkeypatch.setattr(alignment, "MANY", 10**9)
    many = alignment.read_pairs(aligner.align(batch, False))
    assert all((a == b).all() for a, b in zip(few, many, strict=True))
    assert [r[4] for r in want] == [int(many[2][a:b].sum()) for a, b in zip(many[0][:-1], many[0][1:], strict=True)]


def test_alignment_of_nothing(spark):
    assert alignment.align(docs_of(spark, []), BYTE_BPE, PIECE_BPE).count() == 0


def test_stretches_are_skipped_in_few_comparisons():
    import numpy as np

    ends = np.arange(1, 1_000_001, dtype=np.int32)
    assert len(alignment.irregular(ends, ends)) == 0
    odd = np.delete(ends, [10, 500_000, 500_001])
    assert alignment.irregular(odd, ends).tolist() == [[10, 11, 10, 12], [499_999, 500_000, 500_000, 500_003]]


# -- spelling variants --------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_words(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    form = {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def some_words(rng):
    letters = "abeéÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(150)}
    for base in ["x" * 64, "y" * 65, "ab" * 40, "q" * 300]:
        words |= {base, base + "x", base[1:], base[:30] + "z" + base[31:], base[:30] + "z" + base[30:], base[:31] + base[32:], base[:-1] + "k"}
    return {w: rng.randint(3, 60) for w in words}


@pytest.mark.parametrize("seed,most,zone", [(1, 100, 2), (2, 3, 2), (3, 0, 1), (4, 1, 2)])
def test_variants_equal_brute_force(spark, seed, most, zone):
    words = some_words(random.Random(seed))
    df = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    got = spelling.variants(df, most=most, zone=zone)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == plain_variants(words)


def test_words_are_counted_and_misspelt_by_rule(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(base) for _ in range(80)).title() + "×ÉabcdE 12 l’eau") for i in range(60)] + [(None, base[0] * 2 + " " + base[1]), (7, None), (8, "")] + [(9, "same words again " * 3)] * 2
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash"))
    want = plain_words(texts)
    assert {(r["word"], r["n"]) for r in spelling.count_words(df).collect()} == set(want.items())
    assert set(map(tuple, spelling.spelling_variants(df.repartition(7)).collect())) == plain_variants(want)


def test_a_run_is_shortened_once(spark):
    """What is left of one run may be another run of the text that loses a letter too: both keep their own counts."""
    rows = []
    for doc_id in range(50_000):
        h = zlib.crc32(f"{doc_id}:abcdefgh".encode())
        left = "abcdefgh"[: h % 8] + "abcdefgh"[h % 8 + 1 :]
        if h % 97 == 0 and zlib.crc32(f"{doc_id}:{left}".encode()) % 97 == 0:
            rows.append((doc_id, f"abcdefgh {left} " * 3))
    assert rows
    want = plain_words(rows)
    assert {(r["word"], r["n"]) for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(want.items())


def test_long_texts_are_read_in_steps(monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 5)
    text = "abc defghijkl m nop " * 20 + "z" * 50
    assert spelling.runs_of(text) == Counter(text.split())


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, ["", None])).count() == 0


def test_new_queries_on_a_small_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES["op12_align_tokens"](spark, SF).count() == n
    assert QUERIES["op11_pack_matched"](spark, SF).select("doc_id").distinct().count() == n
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert set(map(tuple, QUERIES["op13_spelling_variants"](spark, SF).collect())) == plain_variants(plain_words(texts))
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECE_BPE


# -- parts of the word vocabulary ---------------------------------------------------------------


def test_words_are_one_part_with_and_without_a_blank_and_have_the_ids_of_whole_texts():
    import pyarrow as pa

    from ledgerspark.llm.tokens import Pieces

    coder, seen = Pieces(WORD_BPE, "word"), []
    whole = coder.tokenizer
    coder.tokenizer = type("Counting", (), {"encode_batch_fast": lambda self, x, **how: seen.extend(x) or whole.encode_batch_fast(x, **how)})()
    coder.encode(pa.array(["alphaz betaz alphaz, betaz", "betaz\n étéz 12 "]))
    assert set(coder.young) == {b"alphaz", b"betaz", b",", "étéz".encode(), b"12"}
    assert sorted(seen) == [",", "12"]  # words of small letters go to the merges as one text

    rng = random.Random(3)
    some = ["a", "b", "the", "É", "é", "ß", "÷", "ÿ", "é", "́", " ", "  ", "\n", "\x0b", "\xa0", "　", "\x1c", "\x85", ".", ",", "'s", "'T", "23", "<|endoftext|>", "<|startoftext|>", "<|", "σς", "日", "İ", "ﬁ", "A", " q "]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 14))) for _ in range(3000)] + ["", "  ", None, " x", "foo x<|endoftext|> y"]
    ids, edges = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [e.ids for e in whole.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


# -- images -------------------------------------------------------------------------------------


def test_corners_of_images_below_each_other_are_those_of_each_alone_and_are_stored_once(spark, monkeypatch):
    import numpy as np

    from ledgerspark.llm import media
    from ledgerspark.llm.shared import Tables

    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (int(rng.integers(1, 70)), 41)).astype(np.uint8) for _ in range(60)]
    owner, *columns = media._described(images)
    for i, x in enumerate(images):
        assert list(zip(*[c[owner == i].tolist() for c in columns], strict=True)) == media.describe(x)

    kept, drop, keep_at = {}, Tables.drop, Tables.keep_at
    monkeypatch.setattr(Tables, "keep_at", lambda self, df, *how: (lambda out: kept.update({out[1]: out[0].columns}) or out)(keep_at(self, df, *how)))
    monkeypatch.setattr(Tables, "drop", lambda self, path: kept.pop(path) and drop(self, path))
    rows = [(i, 41, x.tobytes()) for i, x in enumerate([*images[:20], images[0], images[1][:0]])]
    found = {r["image_id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, width int, pixels binary")).collect()}
    assert len(found) == 22 and found[20] == 0
    assert not [x for x in kept.values() if "corners" in x]  # none is left when the links are sought


def test_near_copies_of_a_large_group_are_verified_without_a_row_for_each_pair(spark, monkeypatch):
    """Copies with so many edits that only some are alike at 0.8: groups equal brute force, and no table grows with pairs."""
    from ledgerspark.llm import simhash
    from ledgerspark.llm.shared import Tables

    rng, n = random.Random(21), 400
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        edited = list(base)
        for at in rng.sample(range(100), rng.choice((1, 2, 3, 4, 5, 6))):
            edited[at] = f"e{i}x{at}"
        rows.append((i, " ".join(edited)))
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert 1 < len(set(group)) < n
    kept, keep_at = [], Tables.keep_at

    def counted(self, df, codec="snappy"):
        out = keep_at(self, df, codec)
        kept.append(out[0].count())
        return out

    monkeypatch.setattr(Tables, "keep_at", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"tile": 16}):
        kept.clear()
        got = {r.doc_id: r.first for r in simhash.near_duplicate_groups(frame, buckets=1 << 12, **how).collect()}
        assert got == dict(enumerate(group))
        assert max(kept) < 25 * n, kept  # a prefix has 20 shingles; pairs number 200 times n


def test_prefixes_of_lines_are_kept_once_and_only_while_they_are_read(spark, monkeypatch):
    """At most one table has prefixes once classes stand, and none has when words are read again."""
    from ledgerspark.llm import lines
    from ledgerspark.llm.shared import Tables

    live, seen, keep_at, drop = {}, [], Tables.keep_at, Tables.drop

    def kept(self, df, codec="snappy"):
        out = keep_at(self, df, codec)
        live[out[1]] = "prefix" in df.schema.simpleString()
        seen.append((df.columns, sum(live.values())))
        return out

    def dropped(self, path):
        live.pop(path, None)
        drop(self, path)

    monkeypatch.setattr(Tables, "keep_at", kept)
    monkeypatch.setattr(Tables, "drop", dropped)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]]) + "\n" + " ".join(words)) for i in range(8)]
    got = {r.doc_id: (r.removed, r.n_links) for r in lines.matches(spark.createDataFrame(rows, "doc_id long, text string"), buckets=1 << 10).collect()}
    # Each edited line has 11 of 13 words of the plain one, and 10 of 14 of another.
    assert got == {i: ([0, 1] if i else [1], 9) for i in range(8)}
    assert [n for columns, n in seen if columns == ["id", "keys"]] == [0]
    assert [n for columns, n in seen if columns == ["word", "parts"]][0] == 1


def test_long_lines_that_share_a_rare_word_alone_are_not_read_again(spark, monkeypatch):
    """Lines of 200 words with about half of them in common: 64 parities can't tell them from alike ones, a wide sign can."""
    from ledgerspark.llm import lines
    from ledgerspark.llm.shared import Tables

    rng, keep_at, read = random.Random(5), Tables.keep_at, []

    def kept(self, df, codec="snappy"):
        out = keep_at(self, df, codec)
        if df.columns == ["id", "keys"]:
            read.append(out[0].count())
        return out

    monkeypatch.setattr(Tables, "keep_at", kept)
    texts = [rng.sample([f"w{i}" for i in range(400)], 200) for _ in range(20)]
    texts.append([*[f"x{i}" for i in range(20)], *texts[0][20:]])  # 180 of 220 words
    got = {r.doc_id: (r.removed, r.n_links) for r in lines.matches(docs_of(spark, [" ".join(x) for x in texts]), buckets=1 << 10).collect()}
    assert got == {i: ([0] if i == 20 else [], 1 if i in (0, 20) else 0) for i in range(21)}
    assert read == [2]  # 21 with 64 parities alone


# -- memory of workers --------------------------------------------------------------------------


def test_workers_that_wait_after_packing_hold_no_freed_memory(spark):
    import numpy as np
    import psutil

    rng = np.random.default_rng(3)
    words = [f"w{i:x}" for i in range(100_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 300_000)) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packed = packing.cut(frame, BYTE_BPE, "byte", 0, 1024, False)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == 12

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"mb": [max(p.memory_info().rss >> 20 for p in psutil.Process().parent().children())]})

    assert spark.range(1).mapInArrow(held, "mb long").first().mb < 220  # 169 MB; 266 MB with what Arrow and the C library kept


def test_pipeline_drops_what_operator_4_links(spark):
    """Texts whose fingerprints operator 4 links are near duplicates for the pipeline too, also when few of their passages are equal."""
    import corpus_pipeline
    from ledgerspark.llm import simhash

    rng = random.Random(5)
    rows, no = [(0, "one two three"), (1, "four five six")], 10
    for _ in range(12):
        part = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(40))
        often = " ".join([part] * 12)  # said twelve times; the ends differ
        rows += [(no + i, f"{often} {' '.join(f'{k}{rng.randint(0, 9999)}' for _ in range(60))}") for i, k in enumerate("xy")]
        no += 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    stay = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    by_shingles = {r.doc_id for r in simhash.near_duplicate_groups(docs).collect() if r.doc_id == r.first}
    assert by_shingles == set(linked) and len(set(linked.values())) < len(rows)  # none is alike at 0.8
    assert stay == set(linked.values())

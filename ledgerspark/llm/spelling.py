"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words get marks at both ends. Grams of `shortest` letters that more than `most` places share are made
longer, a letter at a time, up to `longest`: the frequent grams of all lengths are the dictionary, and
a word has at each place the shortest gram that isn't in it. One edit changes the grams that cover its
place and no others, so for each zone of `zone` letters the word's own bound says how many grams an
edit in it can affect, and all the others must be met by a near word. Their lists are merged by an
equi-join on a hash of those grams in order: a row for each zone of a word, without regard to how many
words share any one gram. A word of five letters keeps at least one gram outside each zone, since
`longest` is less than its marked length. Pairs are verified by their edit distance, each in the one
zone where its words first differ.

What is counted follows the whole corpus. Longer grams take up no more than `dictionary` entries a
length: with more grams than that allows, `most` grows with them.

Words of over 64 letters travel by a digest, with digests of what stands beside the zone.

Defined cases: a null or empty text has no words; a null doc_id counts as empty; repeated rows are
counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, documents

RUN, GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
STEP, PAD, LONG = 1 << 20, 2, 64
KEYS = "key long, whole boolean, at int, text string, name string, n long"


def runs_of(text: str) -> Counter:
    """Runs of letters and how often each stands in a text, a megabyte at a time."""
    counts, at = Counter(), 0
    while at < len(text):
        gap = GAP.search(text, at + STEP)
        end = gap.start() if gap else len(text)
        counts.update(RUN.findall(text, at, end))
        at = end
    return counts


def count_words(docs: DataFrame, least_letters: int = 5, least: int = 3, one_in: int = 97) -> DataFrame:
    """word, n: distinct lower-cased runs with at least so many letters and occurrences. Of one in `one_in` pairs of
    document and run, by their CRC-32, a letter is left out."""

    def run(batches):
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)), strict=True):
                prefix, found = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), runs_of(text.as_py())
                shorter: Counter = Counter()  # apart, as what is left of a run may itself be a run to be shortened
                for word in [w for w in found if not zlib.crc32(w.encode(), prefix) % one_in]:
                    i = zlib.crc32(word.encode(), prefix) % len(word)
                    shorter[word[:i] + word[i + 1 :]] += found.pop(word)
                counts.update(found)
                counts.update(shorter)
                if len(counts) > 400_000:
                    yield told()
                    counts.clear()
        yield told()

    found = documents(docs).mapInArrow(run, "word string, n long").where(F.length("word") >= least_letters)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def marked(word: str) -> str:
    return "^" * PAD + word + "$" * PAD


def frequent_grams(words: DataFrame, shortest: int, longest: int, most: int, dictionary: int) -> frozenset:
    """The dictionary: grams of less than `longest` letters that stand in more than `most` places, at most `dictionary` of a length."""

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for word in batch.column(0).to_pylist():
                text = marked(word)
                for size in range(shortest, longest):
                    counts.update([text[i : i + size] for i in range(len(text) - size + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

    places = words.agg(F.sum(F.length("word") + 2 * PAD - shortest + 1)).first()[0] or 0
    found = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return frozenset(x["gram"] for x in found.where(F.col("n") > max(most, places // dictionary)).select("gram").collect())


def decompose(text: str, frequent: frozenset, shortest: int, longest: int) -> list[str]:
    """The gram at each place of a marked word."""
    out = []
    for i in range(len(text) - shortest + 1):
        end = i + shortest
        while end < len(text) and end - i < longest and text[i:end] in frequent:
            end += 1
        out.append(text[i:end])
    return out


def _chained(grams: list[str]) -> list[int]:
    """A hash of each beginning of a list of grams."""
    out, h = [0], 0
    for x in grams:
        h = (h * 0x9E3779B97F4A7C15 + int.from_bytes(x.encode(), "little") + 1) % (2**61 - 1)
        out.append(h)
    return out


def zone_keys(word: str, frequent: frozenset, shortest: int, longest: int, zone: int) -> Iterator[tuple[int, bool, int]]:
    """(key, whole, zone number): `whole` rows are for an edit that replaces or deletes a letter of the zone, the others for one that
    inserts a letter there. The key is a hash of the grams that the edit can't affect, those before and those after the zone."""
    grams = decompose(marked(word), frequent, shortest, longest)
    before, after = _chained(grams), _chained(grams[::-1])
    known = 0
    for number in range(len(word) // zone + 1):
        begin = PAD + number * zone
        while known < len(grams) and known + len(grams[known]) <= begin:  # ends never go back from one place to the next
            known += 1
        for whole in (True, False):
            end = begin + zone - (not whole)
            beyond = max(len(grams) - end, 0)
            if whole and number * zone >= len(word):
                continue
            affected = len(grams) - known - beyond
            assert affected < len(grams), "an edit must leave a gram"
            key = ((before[known] * 0xC2B2AE3D27D4EB4F + after[beyond]) * 0x9E3779B97F4A7C15 + (len(word) + PAD - end) * 1_000_003 + number) % (2**63 - 1)
            yield key, whole, number


def _beside(word: str) -> tuple[list[str], list[str]]:
    """Digests of every beginning of a word and of every rest."""

    def digests(text: str) -> list[str]:
        h, out = hashlib.blake2b(digest_size=12), []
        for i in range(len(text) + 1):
            out.append(h.copy().hexdigest())
            h.update(text[i : i + 1].encode())
        return out

    return digests(word), digests(word[::-1])[::-1]


def keyed(words: DataFrame, frequent: frozenset, shortest: int, longest: int, zone: int) -> DataFrame:
    """A row for each zone and kind of edit of each word: key, whole, and where (`at`) in `text` the zone begins."""
    schema = pa.schema([("key", pa.int64()), ("whole", pa.bool_()), ("at", pa.int32()), ("text", pa.string()), ("name", pa.string()), ("n", pa.int64())])

    def rows(word: str, n: int):
        name = word if len(word) <= LONG else ":" + hashlib.sha256(word.encode()).hexdigest()
        left, right = _beside(word) if len(word) >= LONG else ([], [])
        for key, whole, number in zone_keys(word, frequent, shortest, longest, zone):
            begin = number * zone
            if len(word) + (not whole) <= LONG:  # the longer word of a pair says which form both have
                yield key, whole, begin, word, name, n
            else:
                end = min(begin + zone - (not whole), len(word))
                yield key, whole, len(left[0]), f"{left[begin]}{word[begin:end]}{word[end : end + 1]}:{right[end]}", name, n

    def run(batches):
        held = []
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(word, n):
                    held.append(row)
                    if len(held) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return words.select("word", "n").mapInArrow(run, KEYS)


def near_words(words: DataFrame, tables: Tables, shortest: int = 3, longest: int = 6, zone: int = 2, most: int = 100, dictionary: int = 1 << 16) -> DataFrame:
    """name, n, other, other_n: both directions of each pair of words one edit apart; words of over 64 letters by digest."""
    assert longest < 5 + 2 * PAD - shortest + 1
    rows = tables.keep(keyed(words, frequent_grams(words, shortest, longest, most, dictionary), shortest, longest, zone), "zstd")
    s, r = rows.where("whole").drop("whole").alias("s"), rows.alias("r")

    def head(side: str, more: int) -> Column:
        return F.col(f"{side}.text").substr(F.lit(1), F.col("s.at") + more)

    on = (F.col("s.key") == F.col("r.key")) & (~F.col("r.whole") | (F.col("s.name") < F.col("r.name"))) & (F.col("s.at") == F.col("r.at"))
    pairs = s.join(r, on).where((head("s", 0) == head("r", 0)) & (head("s", zone) != head("r", zone)))
    pairs = pairs.where(F.levenshtein(F.col("s.text"), F.col("r.text"), 1) == 1)
    sides = F.array(*[F.struct(F.col(f"{a}.name").alias("name"), F.col(f"{a}.n").alias("n"), F.col(f"{b}.name").alias("other"), F.col(f"{b}.n").alias("other_n")) for a, b in ("sr", "rs")])
    return pairs.select(F.explode(sides).alias("x")).select("x.*")


def variants(words: DataFrame, least_ratio: int = 2, **index) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): a word's form is its near word of largest n (ties: the first in
    code-point order) if that is at least `least_ratio` times its own; its root is the last of the forms that follow."""
    tables, c = Tables(words.sparkSession, "spelling"), F.col
    words = tables.keep(words.withColumn("name", F.when(F.length("word") <= LONG, c("word")).otherwise(F.concat(F.lit(":"), F.sha2(c("word").cast("binary"), 256)))))
    pairs, digest = tables.keep(near_words(words, tables, **index)), c("other").startswith(":")
    long = words.where(F.length("word") > LONG).select(c("name").alias("other"), c("word").alias("near"))
    pairs = pairs.where(~digest).select("name", c("other").alias("near"), "other_n").unionByName(pairs.where(digest).join(long, "other").select("name", "near", "other_n"))
    best = pairs.groupBy("name").agg(F.count("*").alias("n_near"), F.min(F.struct((-c("other_n")).alias("less"), "near")).alias("x"))
    wins = -c("x.less") >= least_ratio * c("n")
    found = words.join(best, "name", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, c("x.near")).alias("form"), F.when(wins, -c("x.less")).alias("form_n"))
    found = tables.keep(found)
    hops, moved = found.where("form is not null").select("word", c("form").alias("root")), True
    while moved:  # each round doubles how far a root is; n doubles at every form, so there are few
        after = hops.select(c("word").alias("root"), c("root").alias("next"))
        hops = tables.keep(hops.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), c("next").isNotNull().alias("moved")))
        moved = not hops.where("moved").isEmpty()
        hops = hops.drop("moved")
    return found.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants of the words of documents."""
    return variants(count_words(docs))

"""A hidden Markov language model trained over all training documents, and exact text likelihoods.

Tokens are the words, lower-case A-Z, and one end. Every training token is counted (word counts are
aggregated by word, whatever the vocabulary). The `head` most frequent words are the states'
emissions, the end among them; all other words are one emission, times the word's add-one share of
the training tokens outside the head, so the probabilities of all words add up to one.

Training is Baum-Welch over all training tokens: a first pass counts with the state read off the last
anchor (the n-th of the most frequent words) seen in the document, and each of `rounds` passes sums
expected counts by word id over the partitions; the driver holds only the model (states x head).
Texts count whole; those of more than `long_text` tokens are put together, so that the rest needs fewer steps, and those of more
than `cut` are worked on as stretches side by side, chained by the products of their steps. Scores come from the scaled forward
recursion over the whole text.

Counts of the `lookup` most frequent words are broadcast (a bounded table); rarer words join the
count table by word, after one row is made of each document and word.

Defined cases: a null text is empty (the end alone); a null doc_id trains and keeps its row; repeated
rows count and score each; without training tokens every word is unknown and the model is uniform;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables

#: Stands for the end in count tables: no word holds a space.
END = " "
OTHER = 0  # id of the emission of all words outside the head


_SPACE = re.compile("[ \\t-\\r]")


def words_of(text: str) -> list[bytes]:
    """The words as UTF-8, lower-case A-Z (bytes.lower and bytes.split know ASCII alone)."""
    return text.encode().lower().split()


def slices(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about `most` characters, cut at white space, so that few words are held at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + most)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


#: Expected or first counts of starts (S), steps (S x S) and emissions (S x ids).
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


class Model:
    """start (S), step (S x S), emit (S x ids): probabilities of states and word ids."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, emit: np.ndarray, smooth: float = 1.0) -> Model:
        """From counts; emissions are drawn towards the words' shares over all states."""
        share = (emit.sum(0) + 1e-3) / (emit.sum() + 1e-3 * emit.shape[1])
        emit = emit + smooth * len(start) * share
        step = step + 0.1
        start = start + 0.1
        return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, runs: list[np.ndarray], starts: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each sequence of word ids, by the scaled forward recursion.

        starts: for each sequence the shares of states at its first token, if they aren't the model's."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        sizes = np.array([len(runs[i]) for i in order])
        begins = np.cumsum(sizes) - sizes
        flat, table = np.concatenate([runs[i] for i in order]), np.ascontiguousarray(self.emit.T)
        now = self.start if starts is None else starts[order]
        total = np.zeros(len(runs))
        for t in range(sizes[0]):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t
            here = table[flat[begins[:n] + t]]
            now = (now if t == 0 else now[:n] @ self.step) * here
            scale = now.sum(1)
            now /= scale[:, None]
            total[:n] += np.log10(scale)
        out = np.empty(len(runs))
        out[order] = total
        return out

    def along(self, text: np.ndarray, stretch: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """A very long text as stretches of so many tokens, the forward vector at the end of the one before each (zeros for
        the first) and, up to a factor, the backward vector at each one's end.

        The product of a stretch's steps is a matrix of states; all stretches are multiplied side by side, then chained. So a
        text takes as many steps as a stretch has tokens, and memory for its stretches alone, not for its tokens' states."""
        parts = [text[i : i + stretch] for i in range(0, len(text), stretch)]
        s, whole = len(self.start), len(text) // stretch
        table = np.ascontiguousarray(self.emit.T)
        square = np.ascontiguousarray(text[: whole * stretch].reshape(whole, stretch).T)
        through = np.broadcast_to(np.eye(s), (whole, s, s))
        for ids in square:
            through = (through.reshape(-1, s) @ self.step).reshape(whole, s, s) * table[ids][:, None, :]
            through /= through.sum((1, 2), keepdims=True)
        now = self.start
        for t, x in enumerate(parts[0]):  # the first token is drawn from the start
            now = (now if t == 0 else now @ self.step) * table[x]
            now = now / now.sum()
        before, after = np.zeros((len(parts), s)), np.ones((len(parts), s))
        for i in range(1, len(parts)):
            before[i] = now
            if i < whole:
                now = now @ through[i]
                now = now / now.sum()
        back = np.ones(s)
        if whole < len(parts):
            for x in parts[-1][::-1]:
                back = self.step @ (table[x] * back)
                back = back / back.sum()
        for i in range(whole - 1, -1, -1):
            after[i] = back
            back = through[i] @ back
            back = back / back.sum()
        return parts, before, after

    def log10_long(self, text: np.ndarray, stretch: int) -> float:
        """log10 of a very long text's probability, by its stretches."""
        parts, before, _ = self.along(text, stretch)
        starts = before @ self.step
        starts[0] = self.start
        return float(self.log10(parts, starts).sum())

    def expect_long(self, text: np.ndarray, stretch: int, batch_tokens: int) -> Counts:
        """Expected counts over a very long text, so many tokens' stretches at a time."""
        parts, before, after = self.along(text, stretch)
        sums, some = None, max(1, batch_tokens // stretch)
        for i in range(0, len(parts), some):
            found = self.expect(parts[i : i + some], before[i : i + some], after[i : i + some])
            sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
        return sums

    def expect(self, texts: list[np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None) -> Counts:
        """Expected counts of starts, steps and emissions over whole texts, or over stretches of one text.

        before, after: for each stretch the forward vector at the end of the one before (zeros: it starts the text) and,
        up to a factor, the backward vector at its end."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        at = np.concatenate(([0], np.cumsum(alive)))
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate([texts[i] for i in order])
        ids = np.concatenate([flat[starts[:n] + t] for t, n in enumerate(alive)]).astype(np.int64)
        step, begin = self.step.astype(np.float32), self.start.astype(np.float32)
        if before is not None:
            before = before[order].astype(np.float32)
            first = before.sum(1) == 0
            begin = np.where(first[:, None], begin, before @ step)
        here = np.ascontiguousarray(self.emit.T.astype(np.float32))[ids]
        seen, scales = np.empty_like(here), np.empty(len(ids), np.float32)
        for t, n in enumerate(alive):
            a, b = at[t], at[t + 1]
            now = (begin if t == 0 else seen[at[t - 1] : at[t - 1] + n] @ step) * here[a:b]
            scales[a:b] = now.sum(1)
            seen[a:b] = now / scales[a:b, None]
        ends = np.ones((len(texts), len(step)), np.float32) if after is None else after[order].astype(np.float32)
        steps, later = np.zeros(step.shape), np.ones((0, len(step)), np.float32)
        for t in range(len(alive) - 1, -1, -1):
            a, b, n = at[t], at[t + 1], len(later)
            back = ends[: b - a].copy()
            if after is not None:  # at a stretch's last token the states' shares are to add up to one
                back[n:] /= (back[n:] * seen[a + n : b]).sum(1, keepdims=True)
            if n:  # those that go on: later holds the next step's emission, backward value and scale
                back[:n] = later @ step.T
                steps += seen[a : a + n].T @ later
            later = here[a:b] * back / scales[a:b, None]
            seen[a:b] *= back
        emit = np.stack([np.bincount(ids, seen[:, s], self.emit.shape[1]) for s in range(len(step))])
        begun = seen[: len(texts)]
        if before is not None:  # the step into a stretch
            steps += before.T @ later
            begun = begun[first]
        return begun.sum(0, dtype=np.float64), steps * self.step, emit


def anchored(ids: np.ndarray, states: int, ends: np.ndarray) -> np.ndarray:
    """The state of each token: the last anchor (ids 1 to states) seen in its text, else the first one to come, else 0."""
    at = np.where((ids >= 1) & (ids <= states), np.arange(len(ids)), -1)
    begin = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - begin)
    last = np.maximum.accumulate(at)
    found = last >= begin[text]
    coming = np.where(at >= 0, at, len(ids))
    coming = np.minimum.accumulate(coming[::-1])[::-1]
    later = np.minimum(coming, len(ids) - 1)
    return np.where(found, ids[last], np.where(coming < ends[text], ids[later], 1)).astype(np.int64) - 1


def anchored_long(text: np.ndarray, states: int, size: int, piece: int = 1 << 20) -> Counts:
    """First counts of a very long text by the states that `anchored` gives its tokens, a piece at a time."""
    start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
    anchor = (text >= 1) & (text <= states)
    now = int(text[np.argmax(anchor)]) - 1 if anchor.any() else 0
    start[now] = 1
    previous = None
    for i in range(0, len(text), piece):
        ids = text[i : i + piece].astype(np.int64)
        last = np.maximum.accumulate(np.where(anchor[i : i + piece], np.arange(len(ids)), -1))
        s = np.where(last >= 0, ids[last] - 1, now)
        emit += np.bincount(s * size + ids, minlength=states * size).reshape(states, size)
        own = s if previous is None else np.concatenate(([previous], s))
        step += np.bincount(own[:-1] * states + own[1:], minlength=states**2).reshape(states, states)
        now = previous = int(s[-1])
    return start, step, emit


def _counted(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> pa.RecordBatch:
    """Rows of counts by id: word ids, then -1 - state for steps, -1 - states for starts."""
    some = np.flatnonzero(emit.sum(0))
    s = len(start)
    names = np.concatenate((some, -1 - np.arange(s), [-1 - s]))
    values = np.concatenate((emit.T[some], step, start[None]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *[pa.array(values[:, i]) for i in range(s)]], ["id", *[f"c{i}" for i in range(s)]])


def _model(counted: DataFrame, states: int, size: int) -> Model:
    rows = counted.groupBy("id").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(states)]).toPandas()  # states + head rows
    ids, values = rows["id"].to_numpy(dtype=np.int64), rows.drop(columns="id").to_numpy(dtype=np.float64).reshape(-1, states)
    emit, step, start = np.zeros((states, size)), np.zeros((states, states)), np.zeros(states)
    emit[:, ids[ids >= 0]] = values[ids >= 0].T
    for i, v in zip(ids[ids < 0], values[ids < 0], strict=True):
        if i == -1 - states:
            start = v
        else:
            step[-1 - i] = v
    return Model.of(start, step, emit)


def word_counts(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """word, n over the texts (column text) and one end each; a task holds at most so many words at a time."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[b" "] += 1
                for part in slices(text):
                    counts.update(words_of(part))
                    if len(counts) <= most:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, held_out, states: int = 12, head: int = 16_384, lookup: int = 200_000, rounds: int = 2, long_text: int = 1024, batch_tokens: int = 600_000, cut: int = 65_536, stretch: int = 2_048) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    held_out: a Column over doc_id that tells which documents to leave out of training. Texts of more than `cut` tokens are
    worked on as stretches of `stretch` tokens side by side, with the same results up to rounding.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "hmm")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = tables.keep(word_counts(d.where(~F.col("held_out"))))
    n_all, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Words down to a count that at most `lookup` words reach: counts fall into a few hundred classes first.
    size_class = F.floor(F.log2("n") * 8)
    found, least = 0, None
    for k, words in counts.groupBy(size_class.alias("k")).agg(F.count("*")).orderBy(F.desc("k")).collect():
        found += words
        if found > lookup:
            break
        least = k
    frequent = counts.where((F.col("word") == END) | (size_class >= least if least is not None else F.lit(False)))
    top = sorted(((w.encode(), n) for w, n in frequent.collect()), key=lambda x: (-x[1], x[0]))
    ids = {w: i + 1 for i, (w, _) in enumerate(top[:head])}
    end_id = ids.setdefault(b" ", len(ids) + 1)
    size = len(ids) + 1
    n_head, n_top = sum(n for w, n in top if w in ids), len(top)
    n_other, other_words = n_all - n_head, n_words - sum(1 for w, _ in top if w in ids)
    shared = spark.sparkContext.broadcast((ids, dict(top)))

    def encode(batches):
        ids, known = shared.value
        logs = {w: math.log10(n + 1) for w, n in known.items()}
        end_log, none = logs.get(b" ", 0.0), end_id.to_bytes(2, "little")
        for batch in batches:
            rows = []
            for text in batch.column(3).to_pylist():
                n_words, n_others, other_log, head_log, codes, tail = 0, 0, 0.0, end_log, [], Counter()
                for part in slices(text):
                    words = words_of(part)
                    code = np.fromiter((ids.get(w, OTHER) for w in words), np.uint16, len(words))
                    others = [words[i] for i in np.flatnonzero(code == OTHER).tolist()]
                    tail.update(w for w in others if w not in logs)
                    other_log += sum(logs[w] for w in others if w in logs)
                    head_log += sum(map(logs.__getitem__, (w for w in words if w in ids)))
                    n_words, n_others = n_words + len(words), n_others + len(others)
                    codes.append(code.tobytes())
                rows.append((n_words + 1, n_words - tail.total() + (b" " in known), head_log, other_log, n_others, b"".join(codes) + none, list(tail), list(tail.values())))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["row", "doc_id", "held_out", "n_tokens", "n_known", "head_log", "other_log", "n_other", "ids", "rare", "times"])

    coded = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
        encode, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, head_log double, other_log double, n_other long, ids binary, rare array<binary>, times array<long>"
    )
    coded = tables.keep(coded)
    training = coded.where(~F.col("held_out")).select("ids")
    counted = "id long, " + ", ".join(f"c{i} double" for i in range(states))

    def first_pass(batches):
        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
        for batch in batches:
            texts = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
            for x in texts:
                if len(x) > cut:
                    start, step, emit = (a + b for a, b in zip((start, step, emit), anchored_long(x, states, size), strict=True))
            texts = [x for x in texts if len(x) <= cut]
            if not texts:
                continue
            ends = np.cumsum([len(x) for x in texts])
            flat = np.concatenate(texts).astype(np.int64)
            s = anchored(flat, states, ends)
            begin = np.concatenate(([0], ends[:-1]))
            emit += np.bincount(s * size + flat, minlength=states * size).reshape(states, size)
            inside = np.ones(len(flat), bool)
            inside[begin] = False
            to = np.flatnonzero(inside)
            step += np.bincount(s[to - 1] * states + s[to], minlength=states**2).reshape(states, states)
            start += np.bincount(s[begin], minlength=states)
        yield _counted(start, step, emit)

    model = _model(training.mapInArrow(first_pass, counted), states, size)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def expected(batches, sent=sent):
            model, sums = sent.value, [np.zeros(states), np.zeros((states, states)), np.zeros((states, size))]
            pools: tuple[list, list] = ([], [])
            held = [0, 0]
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    text = np.frombuffer(raw, "<u2")
                    if len(text) > cut:
                        sums = [a + b for a, b in zip(sums, model.expect_long(text, stretch, batch_tokens), strict=True)]
                        continue
                    k = int(len(text) > long_text)
                    pools[k].append(text)
                    held[k] += len(text)
                    if held[k] >= batch_tokens:
                        sums = [a + b for a, b in zip(sums, model.expect(pools[k]), strict=True)]
                        pools[k].clear()
                        held[k] = 0
            for texts in pools:
                if texts:
                    sums = [a + b for a, b in zip(sums, model.expect(texts), strict=True)]
            yield _counted(*sums)

        model = _model(training.mapInArrow(expected, counted), states, size)
    sent = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        rows, held = [], 0

        def done():
            found = sent.value.log10([np.frombuffer(x, "<u2") for _, x in rows])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array(found)], ["row", "model_log"])

        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) > 2 * cut:
                    found = sent.value.log10_long(np.frombuffer(raw, "<u2"), stretch)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([found])], ["row", "model_log"])
                    continue
                rows.append((row, raw))
                held += len(raw) // 2
                if held >= 10 * batch_tokens:
                    yield done()
                    rows, held = [], 0
        if rows:
            yield done()

    told = coded.select("row", "ids").mapInArrow(likelihood, "row long, model_log double")
    # Words that aren't in the broadcast table: one row per document and word, joined by word.
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").cast("string").alias("word"), F.col("x.times").alias("times"))
    rest = counts if n_words > n_top else counts.limit(0)
    rare = rare.join(rest, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_log"))
    out = coded.drop("ids", "rare", "times").join(told, "row").join(rare, "row", "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0)).cast("long")
    base = F.col("head_log") + F.col("other_log") + rare_log - F.col("n_tokens") * math.log10(n_all + n_words + 1)
    full = F.col("model_log") + F.col("other_log") + rare_log - F.col("n_other") * math.log10(n_other + other_words + 1)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + rare_known).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))

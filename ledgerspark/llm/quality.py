"""Quality rules: counts of each whole text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: a trusted target (the good
labelled rows, but for those that a seeded hash leaves for the threshold) and the raw corpus (all
documents). A text's score is the mean log ratio over its n-grams. The threshold is fitted on all
other labelled rows, good and bad: of the scores of the good ones the lowest that loses `lost` of
them at most, moved to the middle of the gap to the next bad one below it. Every document at or
above it is kept. DataFrame functions only.

Defined cases: a null text has no words; a text without words scores null and fails the base rules;
a null doc_id is kept; labels may be empty or without good rows left to fit on (then the threshold is
below all scores and the base rules decide);
repeated rows are kept; an empty table gives no rows; extra columns are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, WORD, Tables, let, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words in windows that the text has twice or more; windows are compared by 64-bit hashes of their words.

    Only a text with a repeated window sorts its (hash, place) pairs; equal neighbours give the
    places, and each place adds the words up to the next one, `window` at most.
    """
    n = F.size(words)

    def counted(hashes: Column) -> Column:
        def covered(pairs: Column) -> Column:
            def same(i: Column, by: int) -> Column:
                return F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, i + by)["h"], F.lit(False))

            kept = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, -1) | same(i, 1))
            places = F.array_sort(F.transform(kept, lambda i: F.get(pairs, i)["p"]))
            return let(places, lambda at: F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda sum_, i: sum_ + F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(window)))))

        pairs = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)]))
    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts and base_failed; `_words` stays for what follows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = docs.withColumn("_words", words_of(F.col(text_col)))
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(F.col("_words"), repeated_words).cast("long"),
    })
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def grams(words: Column, buckets: int) -> Column:
    """The buckets of all words and neighbouring pairs."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.when(F.size(words) < 2, one).otherwise(F.concat(one, two))


def labelled(labels: DataFrame, rows: int | None = None, seed: int = 42) -> DataFrame:
    """doc_id and part of labelled rows: target (good ones that the counts trust), good and bad (to fit the threshold on).

    Good: of good quality and not toxic in all rows of the id. All rows, or with `rows` the first of each part by a seeded hash.
    """
    good = F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    each = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"), F.max("quality").alias("quality")).withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    if rows is None:
        half = F.when(F.pmod("turn", F.lit(2)) == 0, "target").otherwise("good")
        return each.select("doc_id", F.when(F.col("good"), half).when(F.col("quality") == 0, "bad").alias("part")).where("part is not null")
    parts = {"target": F.col("good") & (F.pmod("turn", F.lit(2)) == 0), "good": F.col("good") & (F.pmod("turn", F.lit(2)) == 1), "bad": F.col("quality") == 0}
    found = [each.where(which).orderBy("turn", "doc_id").limit(rows).select("doc_id", F.lit(name).alias("part")) for name, which in parts.items()]
    return found[0].union(found[1]).union(found[2])


def lowest_but(scores: DataFrame, lost: float, tables: Tables) -> DataFrame:
    """low, one row: the least of the scores (column score) that `lost` of them reach at most (percentile_disc); null for none.

    Scores are dealt by ranges, equal ones as one row; only the range that the wanted place lies in is numbered.
    """
    ranges = tables.keep(scores.groupBy("score").agg(F.count("*").alias("n")).repartitionByRange("score").withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.sum("n").alias("size"))  # a row for each partition
    every, before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.greatest(F.lit(1), F.ceil(F.lit(lost) * F.sum("size").over(every))).alias("place"))
    one = sizes.where("before < place and place <= before + size").select("range", "before", "place")
    upto = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    near = ranges.join(F.broadcast(one), "range").withColumn("upto", F.col("before") + F.sum("n").over(upto))  # one row
    return near.where("upto >= place").agg(F.min("score").alias("low"))


def fitted(scored: DataFrame, parts: DataFrame, lost: float) -> DataFrame:
    """threshold, one row, from the scores of all labelled documents of the parts good and bad."""
    tables = Tables(scored.sparkSession, "threshold")
    some = scored.where("score is not null and not base_failed").select("doc_id", "score").join(parts.where("part <> 'target'"), "doc_id").groupBy("doc_id", "part").agg(F.max("score").alias("score"))
    some = tables.keep(some)
    low = tables.keep(lowest_but(some.where("part = 'good'"), lost, tables))
    gap = some.where("part = 'bad'").crossJoin(F.broadcast(low)).where("score < low").agg(F.max("score").alias("below"))  # one row
    return low.crossJoin(F.broadcast(gap)).select(F.coalesce((F.col("low") + F.coalesce("below", F.col("low") - 0.1)) / 2, F.lit(float("-inf"))).alias("threshold"))


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, text_col: str = "text") -> DataFrame:
    """bucket, ratio: log of the target's share over the raw corpus's add-one share; the target's counts are joined by
    `buckets` counts dealt out as in the raw corpus, so few trusted rows tell little. `buckets` rows at most."""
    tables = Tables(docs.sparkSession, "quality")
    trusted = tables.keep(labelled(labels).where("part = 'target'").select("doc_id")).withColumn("trusted", F.lit(1))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    d = d.join(trusted, "doc_id", "left").select("trusted", words_of(F.col("_text")).alias("_words"))  # no hint: labels grow with documents
    counted = d.select("trusted", F.explode(let(F.col("_words"), lambda w: grams(w, buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    counted = tables.keep(counted)
    total = counted.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("n_target"))
    share = (F.col("raw") + 1) / (F.col("n_raw") + buckets)
    ratio = F.log((F.col("target") + buckets * share) / (F.col("n_target") + buckets)) - F.log(share)
    return counted.crossJoin(F.broadcast(total)).select("bucket", F.when(F.col("n_target") > 0, ratio).otherwise(F.lit(0.0)).alias("ratio"))  # total: one row


def quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None, lost: float = 0.001, buckets: int = 1 << 16, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, the base counts, base_failed, score, threshold (given, or fitted) and kept of every document."""
    tables = Tables(docs.sparkSession, "ratios")
    weights = tables.keep(ratios(docs, labels, buckets, text_col))
    keys = ["_row", "doc_id", "text_hash", *BASE, "base_failed"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    d = base(d, "_text").withColumns({"_row": F.monotonically_increasing_id(), "text_hash": F.xxhash64("_text")})
    d = d.select(*keys, F.explode_outer(let(F.col("_words"), lambda w: grams(w, buckets))).alias("bucket"))
    # A document's n-grams stand together in one task, so the partial aggregate leaves one row for each.
    d = d.join(F.broadcast(weights), "bucket", "left")  # `buckets` rows at most
    scored = d.groupBy(*keys).agg(F.avg("ratio").alias("score"))
    if threshold is None:
        scored = tables.keep(scored)
        limit = tables.keep(fitted(scored, tables.keep(labelled(labels)), lost))
        scored = scored.crossJoin(F.broadcast(limit))  # one row
    else:
        scored = scored.withColumn("threshold", F.lit(float(threshold)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(0.0)) >= F.col("threshold"))
    return scored.select("doc_id", "text_hash", *BASE, "base_failed", "score", "threshold", kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs without those that the rules reject."""
    good = quality(docs, labels, text_col=text_col, **how).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    return docs.join(good, same, "left_semi")

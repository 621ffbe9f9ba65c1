"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame operations only.

Targets: the sources share `share` of all words by weight; one stops at `most` times its own size,
and the excess is shared again by weight. A target is then a number of blocks of `block` words:
first the sources, then each source's shards get whole blocks by the highest quotients
target / (2 * seats + 1). Inside a (source, shard) cell the documents stand in a seeded order; its
blocks are taken by a seeded permutation of their numbers, at most `most` times each.

Defined cases: a null text has no words and is never taken; the null source is a source of its own,
last; sources without words have the target 0; repeated rows count each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, WORD, Tables

#: A prime, so a step by it visits all of fewer blocks once.
STEP = 2147483647


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2^60 from a seed and columns, the same in any engine that has md5."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size, target; sizes has a row per source: source, source_size."""
    whole, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    t = t.withColumns({
        "total": share * F.sum("source_size").over(whole),
        "weight_left": F.sum("weight").over(whole) - F.sum("weight").over(by_ratio) + F.col("weight"),
        "cap_before": F.sum("cap").over(by_ratio) - F.col("cap"),
    })
    # Sources in ascending cap per weight are capped as long as their share of what is left exceeds the cap.
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    t = t.withColumn("open_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(whole)["level"])
    return t.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def seats(cells: DataFrame, group: list[str], name: list[Column], ideal: str, total: Column) -> DataFrame:
    """cells with `seats`: whole numbers near `ideal` with the sum `total` in each group, by Sainte-Lague.

    Every cell starts at its rounded ideal; all then move one way, none by more than the gap, so the
    quotients of those seats alone decide.
    """
    inside, w = Window.partitionBy(*group), Window.partitionBy(*group)
    c = cells.withColumn("near", F.floor(F.col(ideal) + 0.5).cast("long")).withColumn("gap", total.cast("long") - F.sum("near").over(inside))
    c = c.withColumn("step", F.explode(F.expr("sequence(0L, greatest(abs(gap) - 1, 0L))")))
    seat = F.when(F.col("gap") > 0, F.col("near") + F.col("step")).otherwise(F.col("near") - 1 - F.col("step"))
    c = c.withColumn("quotient", F.when((F.col("gap") != 0) & (seat >= 0), F.col(ideal) / (2 * seat + 1)))
    first = F.when(F.col("gap") > 0, -F.col("quotient")).otherwise(F.col("quotient"))
    c = c.withColumn("place", F.row_number().over(w.orderBy(first.asc_nulls_last(), *name, F.col("step"))))
    c = c.withColumn("moved", F.when(F.col("quotient").isNotNull() & (F.col("place") <= F.abs("gap")), F.signum("gap")).otherwise(0).cast("long"))
    keep = [x for x in cells.columns if x not in group]
    return c.groupBy(*cells.columns).agg((F.first("near") + F.sum("moved")).alias("seats")).select(*group, *keep, "seats")


def _plan(docs: DataFrame, weights, share, most, block, shard_words, seed, text_col, source_col, keep: list[str]) -> DataFrame:
    """Every document with its cell's numbers: n_blocks, cell_size, passes, extra, turn, and the words before it."""
    tables = Tables(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *[F.col(x).alias(f"_{i}") for i, x in enumerate(keep)])
    if not keep:
        d = tables.keep(d)  # three narrow columns; the text is read once
    total = d.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    d = d.withColumn("at", seeded(seed, F.col("doc_id"))).withColumn("shard", F.pmod("at", F.lit(shards)))
    cells = tables.keep(d.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")))  # sources times shards
    aims = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most)
    aims = aims.withColumn("blocks", F.col("target") / block).withColumn("one", F.lit(1))
    aims = seats(aims, ["one"], [F.col("source").asc_nulls_last()], "blocks", F.floor(F.sum("blocks").over(Window.partitionBy("one")) + 0.5))
    aims = tables.keep(aims.select(F.col("source").alias("s"), "source_size", "target", F.col("seats").alias("quota")))
    per = cells.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.withColumn("ideal", F.when(F.col("source_size") > 0, F.col("quota") * F.col("cell_size") / F.col("source_size")).otherwise(0.0))
    per = seats(per, ["source"], [F.col("shard")], "ideal", F.max("quota").over(Window.partitionBy("source")))
    # A cell's words in equal blocks; a full cell is its blocks `most` times over.
    per = per.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("cell_size") / block)).cast("long"))
    whole = (F.col("seats") * block / F.greatest(F.col("cell_size"), F.lit(1))) * F.col("n_blocks")
    per = per.withColumn("taken_blocks", F.least(most * F.col("n_blocks"), F.floor(whole + 0.5).cast("long")))
    per = per.withColumns({"passes": F.floor(F.col("taken_blocks") / F.col("n_blocks")).cast("long"), "turn": F.pmod(seeded(seed, F.col("source"), F.col("shard")), F.col("n_blocks"))})
    per = tables.keep(per.select(F.col("source").alias("s"), F.col("shard").alias("h"), "source_size", "target", "cell_size", "n_blocks", "passes", (F.col("taken_blocks") - F.col("passes") * F.col("n_blocks")).alias("extra"), "turn"))
    cell = Window.partitionBy("source", "shard").orderBy("at", F.col("doc_id").asc_nulls_last(), "size", *[f"_{i}" for i in range(len(keep))])
    d = d.withColumn("before", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return d.join(per, (F.col("source").eqNullSafe(F.col("s"))) & (F.col("shard") == F.col("h")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 32, shard_words: int = 1_000_000, seed: int = 17, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    d = _plan(docs, weights, share, most, block, shard_words, seed, text_col, source_col, [])
    # Block k covers the cell's words from ceil(k * cell_size / n_blocks) up to the next block's first.
    extra = F.expr(
        f"""aggregate(sequence(before * n_blocks div cell_size, (before + size - 1) * n_blocks div cell_size), 0L,
        (sum, k) -> sum + if(pmod(k * pmod({STEP}L, n_blocks) + turn, n_blocks) < extra,
        greatest(0L, least(before + size, ((k + 1) * cell_size + n_blocks - 1) div n_blocks) - greatest(before, (k * cell_size + n_blocks - 1) div n_blocks)), 0L))"""
    )
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") * F.col("size") + F.when(F.col("extra") > 0, extra).otherwise(F.lit(0))).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 32, shard_words: int = 1_000_000, seed: int = 17, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with docs' columns: a row for each whole pass over a document, and one of the
    words in the blocks that the extra pass takes, if any (each with the white space after it)."""
    keep = docs.columns
    d = _plan(docs, weights, share, most, block, shard_words, seed, text_col, source_col, keep)
    text = f"_{keep.index(text_col)}"
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD}{SPACE[:-1]}*)"))
    d = d.withColumn("_words", F.when((F.col("extra") > 0) & (F.col("size") > 0), words))
    part = F.expr(f"array_join(filter(_words, (w, i) -> pmod(((before + i) * n_blocks div cell_size) * pmod({STEP}L, n_blocks) + turn, n_blocks) < extra), '')")
    some = F.filter(F.array(part), lambda x: x != "")
    copies = F.concat(F.array_repeat(F.col(text), F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("int")), F.coalesce(some, F.array().cast("array<string>")))
    d = d.withColumn(text, F.explode(copies))
    return d.select(*[F.col(f"_{i}").alias(x) for i, x in enumerate(keep)])

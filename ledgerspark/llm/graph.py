"""Connected components of a graph of links, with every table distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """v, root (the component's least vertex) of every vertex in links (a, b: long).

    Each round gives a vertex and its root the least root among the vertex's neighbours, then
    follows roots once; a path of n links takes about log n rounds. Minima are pre-aggregated, so
    a vertex with many links stays spread over tasks; each round is a table in the shared folder.
    """
    both = tables.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots, path = tables.keep_at(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        mine, theirs = roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        seen = both.join(mine, "a").join(theirs, "b")
        told = seen.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("rb").alias("root")), F.struct(F.col("ra").alias("v"), F.col("rb").alias("root")))).alias("x")).select("x.*")
        least = told.union(roots.select("v", "root")).groupBy("v").agg(F.min("root").alias("root"))
        up = least.select(F.col("v").alias("root"), F.col("root").alias("top"))
        now, new_path = tables.keep_at(least.join(up, "root", "left").select("v", F.least(F.coalesce("top", "root"), "root").alias("root")))
        same = now.groupBy().agg(F.sum(F.hash("v", "root").cast("long"))).first() == roots.groupBy().agg(F.sum(F.hash("v", "root").cast("long"))).first()
        done = same and now.join(roots, ["v", "root"], "left_anti").isEmpty()
        tables.drop(path)
        roots, path = now, new_path
        if done:
            return roots

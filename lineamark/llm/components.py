"""Connected components of an edge table by large and small stars, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.llm.shared import looked_up, remove, written


def components(edges: DataFrame, at_most: int = 60) -> DataFrame:
    """node, component (the least node that links reach) of every node in edges (a long, b long).

    Alternates two steps until nothing changes: each node ties its larger neighbours to its least one (large
    star), then itself and its smaller neighbours to that (small star). Both keep components as they are, and the
    number of edges never grows. Loops and repeated edges are allowed; no edges give no rows.
    """

    def large(e: DataFrame, total: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        return looked_up(both.where("v > u"), least, ["u"], "n", total).select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame, total: int) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = looked_up(down, least, ["u"], "n", total).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    # written first: what makes the edges is computed once, and loops are looked for in the table
    every = written(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    nodes = every.where("a = b").select("b")
    now, loops = every.where("a <> b"), nodes.count()
    total, last, before = max(1, now.count()), None, None
    for _ in range(at_most):
        now = written(small(large(now, total), total), "stars")
        if before is not None:
            remove(before)
        before = now
        # a forest of stars has no edge whose lower end is another's upper end; equal sums twice: nothing has changed
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == last:
            break
        last = sums
    else:
        raise RuntimeError(f"components did not settle in {at_most} rounds")
    if not loops:
        remove(every)
        nodes = now.where("a = b").select("b")  # none: stars have no loops
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = nodes.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))

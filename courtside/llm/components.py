"""Connected components by alternating large-star and small-star steps, wholly as joins and aggregates.

A hub's edges never meet in one task: the minimum of a node is a partially aggregated ``groupBy`` and the
edges meet it in a sort-merge join, which adaptive execution splits when a key is hot. Each round is written
to the shared folder, so a lost executor costs one round at most; edges never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    j = down.join(low, "u")
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: long) -> (node, component), component being the least node reachable.

    Nodes without an edge are not returned; self-loops and nulls are ignored; repeated edges do no harm; no
    edges give no rows. ``max_rounds`` is a guard only: not converging raises, it never returns a partial result.
    """
    now = written(edges.filter("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        after = written(_small_star(_large_star(now)), "cc")
        drop_written(now)
        now = after
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        if mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("connected components did not converge")

"""Connected components over a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours; sums are partial before they meet, so a hub is no burden."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id, component (the least id reachable) for every id in the (u, v) rows of `edges`.

    Each round writes its edges to the shared folder; it ends when a round
    changes nothing, after a number of rounds that grows with the logarithm of
    the longest chain.  Joins merge, as broadcasts would gather on the driver.
    Loops and repeated edges do nothing; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, seen = scratch.written(both, "edges"), None
    while True:
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = around.join(_least(around).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = _least(large)
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = scratch.written(small.where("u != v").distinct(), "edges")
        # decimal sums can't overflow
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

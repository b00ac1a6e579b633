"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import release, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(id, component) of every node of edges (u, v), with the smallest id of the component.

    A round moves every edge towards the smallest neighbour; star-shaped edges end the loop, after a number of rounds that grows with the logarithm of the
    longest path. Rounds are written, so a lost executor costs one round. Only a count and a hash sum reach the driver.
    rows: the number of rows of edges, where it is known.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc", rows)
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both_from, n = now, before[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "cc-low", 2 * n)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "cc-large", n)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least", n)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "cc", 2 * n)
        release(both_from, low, large, least)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops.select("id", F.col("id").alias("component")))

"""Connected components by alternating large-star and small-star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.runtime import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component_id) of every node that has an edge to another; component_id is its smallest node.

    Every round moves all edges towards the smallest neighbour: a large-star step (neighbours above a node go to the
    least neighbour) and a small-star step (those below it do). A round's table is written to the shared folder, so
    a lost executor costs no more than a round. Hubs are joined, never gathered, so a skewed join can split them.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # now holds u > v: for the lower end v, its upper neighbours u move to the least neighbour of v
        large = now.select(F.col("v").alias("c"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "c"), "c").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(now), release(large)
        before, now, mark = mark, new, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    # `now` stays: the result reads it
    centres = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(centres)


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
    return tuple(r)

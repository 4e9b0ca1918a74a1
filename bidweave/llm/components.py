"""Connected components over edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import discard, materialise

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, least neighbour), summed before the shuffle, so that a hub costs no more than its tasks."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) for every node of ``edges`` (src, dst long), and the scratch table that it reads.

    A component's id is its least node. Each round points every node's larger neighbours at its least one, then
    its smaller ones; the number of rounds grows with the logarithm of the longest path. Edges of each round are
    written to the shared folder, the joins are plain equi-joins that adaptive execution splits where a hub is
    hot, and nothing but counts reaches the driver. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = materialise(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        small_least = _least(large)
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        after, new_path = materialise(small, "edges")
        # Both are sets: they are the same if they are as large and nothing is new.
        settled = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(spark, path)
        now, path = after, new_path
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    parts = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    return parts, path

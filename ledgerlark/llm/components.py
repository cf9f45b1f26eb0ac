"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``links``: nodes share a root if and only if they are connected.

    Links whose end is null are ignored; a self-link makes its node a component.

    Each round gives every node the end with the least random number among its
    neighbours and itself, moves the links to those ends and drops what has become a
    loop; a constant share of the nodes goes each time, however long the chains are,
    and what is kept is linear in the links. Every choice is a minimum by key, so a
    hub costs one row for each task, and the joins carry plain keys that adaptive
    execution can split.
    """
    spark = links.sparkSession
    return settled(spark, lambda: _contracted(links, a, b), "components")


def _contracted(links: DataFrame, a: str, b: str) -> DataFrame:
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    roots = stored(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "components")
    left = stored(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    for turn in range(1000):
        if left.isEmpty():
            return roots
        weight = lambda x: F.xxhash64(F.lit(turn), x)  # noqa: B023, E731
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(weight(F.col("b")).alias("w"), F.col("b").alias("to"))).alias("m"))
        step = stored(best.select("node", F.when(F.struct(weight(F.col("node")).alias("w"), F.col("node").alias("to")) < F.col("m"), F.col("node")).otherwise(F.col("m.to")).alias("to")), "step")
        to = lambda side: step.select(F.col("node").alias(side), F.col("to").alias(f"{side}2"))  # noqa: B023, E731
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        left = stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        roots = stored(roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "components")
    raise RuntimeError("contraction did not end")

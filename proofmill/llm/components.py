"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import Workspace

MAX_ROUNDS = 60


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _star(space: Workspace, pairs: DataFrame, large: bool, name: str) -> DataFrame:
    """Each node's neighbours point at the smallest of its neighbourhood.

    The minima are written, so that the join has an exchange on both sides and a node with very
    many neighbours can be split.
    """
    least = space.save(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    joined = pairs.join(least, "u")
    if large:  # neighbours above the node
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    own = least.where("m != u").select("u", F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(space: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges` (u, v)."""
    now = space.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), f"{name}-0")
    before = _state(now)
    for k in range(1, MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = space.save(_star(space, both, True, f"{name}-{k}-large"), f"{name}-{k}-large")
        down = wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new = space.save(_star(space, down, False, f"{name}-{k}"), f"{name}-{k}")
        for done in (f"{name}-{k}-large", f"{name}-{k}-large-least", f"{name}-{k}-least"):
            space.drop(done)
        space.drop(f"{name}-{k - 1}")
        now, after = new, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.session import discard, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) of every node of ``links`` (a, b); nulls and loops are left out.

    Each step replaces links by links to smaller nodes with a minimum per node, joined back: no node's
    neighbours are collected. Steps are written tables. An empty table gives no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = materialise(edges), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").filter("u <> v").distinct())
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
    raise RuntimeError("components did not settle")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more ``links``, from those before (node, root): only links between different components are followed."""
    if roots is None:
        return components(links)
    at = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    far = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    far = materialise(far.filter("a <> b").distinct())
    if far.isEmpty():
        discard(far)
        return roots
    new = components(far)
    discard(far)
    old = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialise(old.unionByName(new.join(roots, "node", "left_anti")))

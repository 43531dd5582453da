"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, drop


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v): every node's neighbours are linked to the smallest of them.

    The minimum is aggregated map-side and written down before the join, so that both inputs of the
    join are plain exchanges and a hub's edges can be split over tasks.
    """
    smallest = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc_min")
    joined = pairs.join(smallest, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = smallest.select("u", F.col("m").alias("v"))
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    out = cut(out.where("u <> v").distinct(), "cc_edges")
    drop(smallest)
    return out


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; rows with a null end and loops are
    ignored.  Returns ``node`` and ``component`` (the smallest node of the component, itself
    included).  No edges: an empty frame.  Rounds grow with the logarithm of the longest path.
    """
    edges = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc_edges",
    )
    before = None
    for _ in range(max_rounds):
        large = _star(_both_ways(edges), large=True)
        small = _star(large.where("u > v"), large=False)
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges, large)
        edges = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Connected components of a graph that is never in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.plans.staging import discard, stage


def _both(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionAll(back)


def _least(pairs: DataFrame) -> DataFrame:
    """The least of each node and its neighbours; combined before the shuffle."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (longs, not null).

    ``component`` is the least node of the component.  Rounds of the large
    and the small star connect every node to ever lesser neighbours until
    nothing changes; a hub with most of the edges is only ever a key of
    minima and of joins that Spark can split.  Edges from a node to itself
    are left out, and so is a node that has no others.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if mark == before:
            break
        before = mark
        # large star: greater neighbours go to the least one
        pairs = _both(edges)
        # minima are written out, so that joins read both sides from exchanges and can split a hub
        least = stage(_least(pairs), "least")
        large = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large-star")
        # small star: a node and its lesser neighbours go to the least one
        discard(least)
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = stage(small, "small-star")
        discard(edges, large, least)
        edges = small
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

"""Connected components by contraction, as DataFrame rounds.

In each round every node moves to the node of lowest random priority within two steps;
the moved-to nodes carry on with the edges between them.  A star collapses in one round
and a path by a constant factor, so rounds grow with the logarithm of the longest path.
Aggregates are minima (combined before the shuffle), and edges of nodes that have very
many of them are joined to what is known of these few nodes without a shuffle, so a hub is
no hot task.  Nothing reaches the driver but sums and whether edges remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, hot_keys, join_hot, settle


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)`` for every end of an edge in ``edges(a, b)``; ``component`` is
    the smallest id reachable.  Loops and repeated edges are harmless; null ends are
    left out."""
    live = settle(
        edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges"
    )
    places = live.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("node"))
    live = live.where("a <> b")
    round_ = 0
    while not live.isEmpty():
        priority = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("p"), c.alias("n"))  # noqa: B023, E731
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = both.groupBy("a").agg(F.min(priority(F.col("b"))).alias("m"), F.count("*").alias("edges"))
        one = settle(one.select("a", F.least("m", priority(F.col("a"))).alias("m"), "edges"), f"{label}-nodes")
        hubs = hot_keys(one, ["a"], "edges", LEAST_HOT)
        named = lambda c: None if hubs is None else hubs.select(F.col("a").alias(c))  # noqa: B023, E731
        reach = join_hot(both, one.select(F.col("a").alias("b"), "m"), ["b"], named("b"))
        moved = settle(reach.groupBy("a").agg(F.min("m").alias("m")).join(one.select("a", F.col("m").alias("own")), "a").select(F.col("a").alias("node"), F.least("m", "own")["n"].alias("to")), f"{label}-moves")
        ends = join_hot(live, moved.select(F.col("node").alias("a"), F.col("to").alias("x")), ["a"], named("a"))
        ends = join_hot(ends, moved.select(F.col("node").alias("b"), F.col("to").alias("y")), ["b"], named("b"))
        places = settle(places.join(moved, "node", "left").select("id", F.coalesce("to", "node").alias("node")), f"{label}-places")
        live = settle(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges")
        round_ += 1
    least = places.groupBy("node").agg(F.min("id").alias("component"))
    return places.join(least, "node").select("id", "component")

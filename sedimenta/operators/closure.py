"""Closures over links, as frontier rounds: each joins the newest nodes with the links and
drops what has been seen, so cycles end and depth is not limited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from .guards import refuse_any
from .shared import settled


def reachable(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, depth`` of all nodes that ``seeds(node)`` reach over ``links(source, target)``,
    seeds included at depth 0."""
    pairs = settled(links.select("source", "target").distinct().repartition("source"), "links")  # once for all rounds
    seen = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "closure")
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(pairs, frontier.node == pairs.source).select(F.col("target").alias("node")).distinct()
        frontier = settled(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def both_ways(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ancestors and descendants of the seeds, with the seeds."""
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reachable(links, seeds).select("node").unionByName(reachable(back, seeds).select("node")).distinct()


def refuse_cycles(links: DataFrame) -> None:
    """Peels nodes without incoming links until none is left; what stays holds a cycle."""
    left = settled(links.select("source", "target").distinct(), "cycle")
    while True:
        roots = left.select("source").distinct().join(left.select(F.col("target").alias("source")).distinct(), "source", "left_anti")
        if roots.isEmpty():
            break
        left = settled(left.join(roots, "source", "left_anti"), "cycle")
    refuse_any(left, "links form a cycle")


def check_provenance(generations: DataFrame, usages: DataFrame, derivations: DataFrame) -> None:
    """``generations(entity, activity, at)``, ``usages(entity, at)``, ``derivations(entity,
    source)``: an entity is generated once, used no earlier, and strictly later than its
    sources; derivations have no cycles."""
    refuse_any(generations.select("entity", "activity").distinct().groupBy("entity").count().where("count > 1"), "an entity is generated twice")
    made = generations.select("entity", F.col("at").alias("made"))
    refuse_any(usages.join(made, "entity").where("at < made"), "an entity is used before it is generated")
    sources = made.select(F.col("entity").alias("source"), F.col("made").alias("source_made"))
    refuse_any(derivations.join(made, "entity").join(sources, "source").where("made <= source_made"), "an entity is no later than its source")
    refuse_cycles(derivations.select(F.col("source"), F.col("entity").alias("target")))


def operation_order(dependencies: dict[str, list[str]]) -> list[str]:
    """Names in an order where dependencies come first, ties by name; an unknown name or a
    cycle refuses."""
    unknown = {d for ds in dependencies.values() for d in ds} - dependencies.keys()
    if unknown:
        raise Refused(f"unknown dependencies {sorted(unknown)}")
    left, out = {k: set(v) for k, v in dependencies.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise Refused(f"dependencies form a cycle among {sorted(left)}")
        out.append(ready[0])
        del left[ready[0]]
        for v in left.values():
            v.discard(ready[0])
    return out

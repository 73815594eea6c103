"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix, at most ``most_copies`` times its size; what
a source cannot take is shared again by weight.  A document's expected copies are
target / size of its source: the whole part is allocated with certainty, and the rest is
drawn.  Each document gets a uniform number U from a seeded hash of its id, and is ranked
by Pareto's ratio  (U / (1 - U)) / (p / (1 - p))  for its inclusion probability p; the
lowest ranks are taken until their sizes reach what the source still lacks.

No source is gathered in one task: sizes are summed by (source, slice of the ranking), a
running sum over those sums finds the one slice that holds the cut, and only that slice
is ordered row by row.

Defined results: a null text has size 0; a null source is a source, last in order; a
source of size 0 has target 0; repeated rows are drawn each, copies of one row in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa

from .common import BY_SPACE, blocks, settle, text_buffer, word_spans

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SLICES = 4096
SEED = 20240917


def with_sizes(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``size``: the number of white-space-separated words of the whole text."""

    def count(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("__t"))
            sizes = [np.diff(word_spans(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SPACE)[2]) for a, b in blocks(offsets)]
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(sizes, pa.int64())], names=[*keys, "size"])

    rows = docs.select(*keys, F.col(text_col).cast("string").alias("__t"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(count, f"{kinds}, size long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target``: one row a source.  Sources enter in the order of
    the size their weight would need to reach the bound, and the bound holds for those
    before the first that stays below it."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = per.select("source", "source_size", pick.alias("w"))
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    steps = weighed.select(
        "source", "source_size", "w",
        (F.lit(float(share)) * F.sum("source_size").over(every)).alias("total"),
        F.coalesce(F.sum("source_size").over(by_need) * most, F.lit(0)).alias("capped"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_need), F.lit(0.0))).alias("open_w"),
    )
    below = F.col("w") * (F.col("total") - F.col("capped")) <= most * F.col("source_size") * F.col("open_w")
    judged = steps.select("*", F.min(F.when(below, F.struct("capped", "total", "open_w"))).over(every).alias("l"))
    return judged.select(
        "source", "source_size",
        F.coalesce(
            F.least((F.col("source_size") * most).cast("double"), F.col("w") * (F.col("l.total") - F.col("l.capped")) / F.col("l.open_w")),
            (F.col("source_size") * most).cast("double"),
        ).alias("target"),
    )


def pareto_rank(probability: Column, *key: Column, seed: int = SEED) -> Column:
    """Random odds over inclusion odds; grows with U for a fixed probability.  U comes
    from the first 52 bits of a SHA-256 of the seed and the key."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return (u / (1 - u)) / (probability / (1 - probability))


def _slice(rank: Column) -> Column:
    """Ranks in 4096 slices of equal share where odds are uniform odds over a constant."""
    return F.floor(rank / (rank + 1) * SLICES)


def plan_mix(sized: DataFrame, key: Column, **how) -> DataFrame:
    """Adds ``source_size, target, copies`` to rows that have ``source, size``.  Copies
    come with certainty or from the draw; a document never has more than ``most``."""
    targets = settle(source_targets(sized, **how), "mix-targets")
    # A source is a small integer here: null sources join as well.
    joined = sized.join(targets, sized.source.eqNullSafe(targets.source), "left").drop(targets.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    most = how.get("most", MOST_COPIES)
    sure = F.least(F.floor(ratio), F.lit(most)).cast("int")
    rows = joined.select("*", sure.alias("__sure"), (ratio - sure).alias("__p"))
    drawn = F.col("__p") > 0
    rank = F.when(drawn, pareto_rank(F.col("__p"), key))
    rows = rows.select("*", rank.alias("__rank"), _slice(rank).alias("__slice"))
    lacks = F.col("target") - F.col("__sure") * F.col("source_size")
    sums = rows.where(drawn).groupBy("source", "__slice").agg(F.sum("size").alias("s"), F.first(lacks).alias("lack"))
    running = Window.partitionBy("source").orderBy("__slice")
    sums = sums.select("source", "__slice", "lack", F.sum("s").over(running).alias("upto"), "s")
    cuts = sums.where("upto - s < lack").groupBy("source").agg(
        F.max("__slice").alias("cut"), F.max_by(F.col("upto") - F.col("s"), "__slice").alias("had"), F.first("lack").alias("lack")
    )
    cuts = settle(cuts.withColumnRenamed("source", "cut_source"), "mix-cuts")
    rows = rows.join(cuts, rows.source.eqNullSafe(cuts.cut_source), "left").drop("cut_source")
    # The slice of the cut, in order: take a row while that brings the sum nearer to what lacks.
    edge = rows.where(drawn & (F.col("__slice") == F.col("cut")))
    along = Window.partitionBy("source").orderBy("__rank", key, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.col("had") + F.sum("size").over(along)
    edge = edge.withColumn("__extra", (F.abs(got - F.col("lack")) <= F.abs(got - F.col("size") - F.col("lack"))) & (got - F.col("size") < F.col("lack")))
    rest = rows.where(~(drawn & (F.col("__slice") == F.col("cut"))) | F.col("cut").isNull() | ~drawn)
    rest = rest.withColumn("__extra", drawn & F.coalesce(F.col("__slice") < F.col("cut"), F.lit(False)))
    out = rest.unionByName(edge)
    copies = F.col("__sure") + F.when(F.col("__extra"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).drop("__sure", "__p", "__rank", "__slice", "__extra", "cut", "had", "lack")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sized = settle(with_sizes(docs, ["doc_id", "source"]), "mix-sizes")
    out = plan_mix(sized, F.col("doc_id"), **how)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with ``docs``' columns.
    A row without an id is known by its text."""
    names = docs.columns
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256))))
    sized = settle(with_sizes(keyed, ["__key", "source"]), "mix-sizes")
    plan = settle(plan_mix(sized, F.col("__key"), **how).groupBy("__key").agg(F.max("copies").alias("__copies")).where("__copies > 0"), "mix-plan")
    rows = keyed.join(plan.hint("merge"), "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(*names)

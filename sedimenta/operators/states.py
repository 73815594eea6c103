"""Keyed states: immutable sets of ``member_key -> occurrence_id``, their edits and diffs.

A membership is a DataFrame ``(member_key, occurrence_id)``; entities are
``(occurrence_id, value)`` with canonical JSON text; edits are ``(member_key, sequence,
action, occurrence_id)`` with action ``put`` or ``remove``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LimitExceeded, Refused
from ..functions.json import json_string
from ..functions.text import NAMESPACE
from .guards import refuse_any, unique
from .shared import settled

SAMPLE_MOST = 2048


def mint(rows: DataFrame, batch: str, kind: str = "occurrence") -> DataFrame:
    """``(member_key, occurrence_id, value)`` of ``rows(member_key, value)``: an occurrence
    is named by its batch, key and value, so a retry names the same and another batch not."""
    name = F.sha2(F.concat(json_string(F.lit(batch)), F.lit(","), json_string(F.col("member_key")), F.lit(","), F.col("value")), 256)
    return rows.select("member_key", F.concat(F.lit(f"{NAMESPACE}:{kind}:v1:"), name).alias("occurrence_id"), "value")


def create(rows: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(membership, entities) of keyed rows; a repeated or null key refuses."""
    refuse_any(rows.where(F.col("member_key").isNull() | F.col("value").isNull()), "a row lacks its key or value")
    unique(rows, ["member_key"])
    minted = mint(rows, batch)
    return minted.select("member_key", "occurrence_id"), minted.select("occurrence_id", "value")


# --- edits ------------------------------------------------------------------------


def invalid_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Removes that do not hit a live key at their sequence: the key's edit before is a
    remove, or there is none and the base lacks the key."""
    before = F.lag("action").over(Window.partitionBy("member_key").orderBy("sequence"))
    placed = edits.select("member_key", "sequence", "action", before.alias("previous")).where("action = 'remove'")
    first = placed.where("previous is null").join(base.select("member_key"), "member_key", "left_anti")
    return placed.where("previous = 'remove'").unionByName(first).select("member_key", "sequence")


def latest_edits(edits: DataFrame) -> DataFrame:
    """The edit of highest sequence per key, by a combinable aggregate."""
    last = F.max_by(F.struct("action", "occurrence_id"), "sequence")
    return edits.groupBy("member_key").agg(last.alias("last"), F.max("sequence").alias("sequence")).select("member_key", "sequence", "last.action", "last.occurrence_id")


def resolve_edits(base: DataFrame, edits: DataFrame, *, check: bool = True) -> DataFrame:
    """Base without edited keys, with each key's last put."""
    if check:
        unique(edits, ["member_key", "sequence"], "a key is edited twice at one sequence")
        refuse_any(invalid_edits(base, edits), "a remove names no live key")
    last = latest_edits(edits)
    kept = base.join(last.select("member_key"), "member_key", "left_anti")
    return kept.select("member_key", "occurrence_id").unionByName(last.where("action = 'put'").select("member_key", "occurrence_id"))


def unavailable_puts(edits: DataFrame, *sources: DataFrame) -> DataFrame:
    """Puts whose occurrence no source has."""
    puts = edits.where("action = 'put'").select("member_key", "occurrence_id")
    known = sources[0].select("occurrence_id")
    for s in sources[1:]:
        known = known.unionByName(s.select("occurrence_id"))
    return puts.join(known.distinct(), "occurrence_id", "left_anti")


def upsert(base: DataFrame, entities: DataFrame, rows: DataFrame, batch: str, removals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, new entities): ``rows(member_key, value)`` replace or add, ``removals
    (member_key)`` go.  A repeated key, a key both put and removed, an absent removal and
    an empty batch refuse."""
    if rows.isEmpty() and (removals is None or removals.isEmpty()):
        raise Refused("a batch is empty")
    unique(rows, ["member_key"])
    minted = mint(rows, batch)
    gone = rows.select("member_key")
    if removals is not None:
        refuse_any(removals.join(rows, "member_key", "left_semi"), "a key is put and removed")
        refuse_any(removals.join(base, "member_key", "left_anti"), "a removal names no member")
        gone = gone.unionByName(removals.select("member_key"))
    kept = base.join(gone, "member_key", "left_anti").select("member_key", "occurrence_id")
    return kept.unionByName(minted.select("member_key", "occurrence_id")), minted.select("occurrence_id", "value")


# --- comparison ---------------------------------------------------------------------


def differing(older: DataFrame, newer: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``member_key, change, older_id, newer_id`` where the memberships differ.  ``keys``,
    where a history certifies them, narrows both sides before the join."""
    if keys is not None:
        older, newer = (s.join(keys.select("member_key").distinct(), "member_key", "left_semi") for s in (older, newer))
    a = older.select("member_key", F.col("occurrence_id").alias("older_id"))
    b = newer.select("member_key", F.col("occurrence_id").alias("newer_id"))
    change = F.when(F.col("older_id").isNull(), "added").when(F.col("newer_id").isNull(), "removed").otherwise("changed")
    return a.join(b, "member_key", "full_outer").where(~F.col("older_id").eqNullSafe(F.col("newer_id"))).select("member_key", change.alias("change"), "older_id", "newer_id")


def change_counts(older: DataFrame, newer: DataFrame) -> DataFrame:
    return differing(older, newer).groupBy("change").agg(F.count("*").alias("n"))


def compare(older: DataFrame, newer: DataFrame, old_values: DataFrame, new_values: DataFrame, *, sample: int = 100) -> tuple[DataFrame, DataFrame]:
    """(counts by change, the first ``sample`` differing keys with their values).  Values are
    joined for the sample alone."""
    if not 0 <= sample <= SAMPLE_MOST:
        raise LimitExceeded("the sample is out of bounds")
    diff = differing(older, newer)
    first = diff.orderBy("member_key").limit(sample)
    values = first.join(old_values.select(F.col("occurrence_id").alias("older_id"), F.col("value").alias("older_value")), "older_id", "left").join(
        new_values.select(F.col("occurrence_id").alias("newer_id"), F.col("value").alias("newer_value")), "newer_id", "left"
    )
    seen = values.withColumn("value_changed", ~F.col("older_value").eqNullSafe(F.col("newer_value")))
    return diff.groupBy("change").agg(F.count("*").alias("n")), seen.select("member_key", "change", "older_id", "newer_id", "older_value", "newer_value", "value_changed").orderBy("member_key")


def changes(older: DataFrame, newer: DataFrame, new_values: DataFrame) -> DataFrame:
    """``member_key, occurrence_id, value`` of the newer state at differing keys; both null
    where the key is gone."""
    diff = differing(older, newer).select("member_key", F.col("newer_id").alias("occurrence_id"))
    return diff.join(new_values, "occurrence_id", "left").select("member_key", "occurrence_id", "value")


def key_changes(older: DataFrame, newer: DataFrame) -> DataFrame:
    return differing(older, newer).select("member_key", "change")


def same_membership(left: DataFrame, right: DataFrame) -> bool:
    return differing(left, right).isEmpty()


# --- reading ---------------------------------------------------------------------


def named_scope(membership: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted key, once; an absent one has a null occurrence."""
    return wanted.select("member_key").distinct().join(membership, "member_key", "left").select("member_key", "occurrence_id")


def keyed_values(membership: DataFrame, entities: DataFrame) -> DataFrame:
    """``member_key, occurrence_id, value``."""
    return membership.join(entities, "occurrence_id", "left").select("member_key", "occurrence_id", "value")


def incomplete_members(membership: DataFrame, entities: DataFrame) -> DataFrame:
    """Members that name a missing entity."""
    return membership.join(entities.select("occurrence_id"), "occurrence_id", "left_anti")


def conflicting_values(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Entities that two layers hold with different values."""
    b = newer.select("occurrence_id", F.col("value").alias("other"))
    return older.join(b, "occurrence_id").where(~F.col("value").eqNullSafe(F.col("other")))


def find_members(wanted: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """``occurrence_id, value`` from the newest layer (the first) that has it; copies that
    differ refuse."""
    ranked = None
    for i, layer in enumerate(layers):
        own = layer.select("occurrence_id", "value", F.lit(i).alias("rank")).join(wanted.select("occurrence_id").distinct(), "occurrence_id", "left_semi")
        ranked = own if ranked is None else ranked.unionByName(own)
    found = ranked.groupBy("occurrence_id").agg(F.min_by("value", "rank").alias("value"), F.count_distinct(F.sha2("value", 256)).alias("versions"))
    refuse_any(found.where("versions > 1"), "copies of an entity differ")
    return found.select("occurrence_id", "value")


def checkpoint_order(membership: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities that a state uses, once each, with the first key that uses them."""
    first = membership.groupBy("occurrence_id").agg(F.min("member_key").alias("first_key"))
    return entities.join(first, "occurrence_id").select("first_key", "occurrence_id", "value")


def positions(rows: DataFrame, by: Column) -> DataFrame:
    """Rows with ``position`` (0 ...) in a global order, without one task for all rows:
    sorted ranges are written, counted, and each row is placed after the ranges before.
    Sizes are one row a range, so they are broadcast."""
    ranged = rows.withColumn("__k", by).repartitionByRange("__k").sortWithinPartitions("__k").withColumn("__p", F.spark_partition_id())
    ranged = settled(ranged.withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("__k"), "positions")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("__p", before.alias("__before"))), "__p").withColumn("position", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")

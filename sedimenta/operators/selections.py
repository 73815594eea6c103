"""Selections: projections of states compared as multisets or sequences."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_string, member_text, pointer_tokens, selected


def extract(rows: DataFrame, value: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Adds per (label, pointer of object keys) a struct(state, kind, value)."""
    for _, pointer in fields:
        pointer_tokens(pointer)
    parsed = rows.withColumn("__v", F.parse_json(F.col(value)))
    return parsed.select(*rows.columns, *[selected("__v", pointer).alias(label) for label, pointer in fields])


def labelled(fields: list[str]) -> Column:
    """Canonical array of ``[label,"absent"]`` or ``[label,"present",value]``."""
    one = lambda f: F.when(F.col(f"{f}.state") == "absent", F.concat(F.lit("["), json_string(F.lit(f)), F.lit(',"absent"]'))).otherwise(
        F.concat(F.lit("["), json_string(F.lit(f)), F.lit(',"present",'), F.coalesce(F.col(f"{f}.value"), F.lit("null")), F.lit("]"))
    )
    return F.concat(F.lit("["), F.concat_ws(",", *[one(f) for f in fields]), F.lit("]"))


def encoded_members(members: DataFrame, value: Column, *, material_keys: bool = False, material_entities: bool = False) -> DataFrame:
    """``member_key, occurrence_id, encoded``: what each member compares by."""
    text = member_text(value, F.col("member_key") if material_keys else None, F.col("occurrence_id") if material_entities else None)
    return members.select("member_key", "occurrence_id", text.alias("encoded"))


def multiset_difference(older: DataFrame, newer: DataFrame, column: str = "encoded") -> DataFrame:
    """Values whose numbers differ, by signed weights: ``column, weight``."""
    both = older.select(F.col(column), F.lit(-1).alias("w")).unionByName(newer.select(F.col(column), F.lit(1).alias("w")))
    return both.groupBy(column).agg(F.sum("w").alias("weight")).where("weight <> 0")


def same_multiset(older: DataFrame, newer: DataFrame, column: str = "encoded") -> bool:
    return multiset_difference(older, newer, column).isEmpty()


def ordered(members: DataFrame, sort_key: list[Column], descending: bool = False) -> DataFrame:
    """Members by a declared key, ties by member key ascending."""
    keys = [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in sort_key]
    return members.orderBy(*keys, F.col("member_key").asc())


def selection_delta(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Keys to evaluate again: ``member_key, occurrence_id`` of the current state, null
    where the member is gone."""
    a = prior.select("member_key", F.col("occurrence_id").alias("old"))
    b = current.select("member_key", F.col("occurrence_id").alias("occurrence_id"))
    return a.join(b, "member_key", "full_outer").where(~F.col("old").eqNullSafe(F.col("occurrence_id"))).select("member_key", "occurrence_id")


def overlay(original: DataFrame, changes: DataFrame) -> DataFrame:
    """Original members without changed ones, with the changed ones that are left."""
    kept = original.join(changes.select("member_key"), "member_key", "left_anti")
    return kept.unionByName(changes.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in changes.columns])).select(*kept.columns))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free, combinable fingerprint of a multiset: rows and the sum of their hashes."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash_sum"))


def stream_digest(rows: DataFrame, encoded: str, order: list[str]) -> DataFrame:
    """``members, digest``: SHA-256 of the canonical array of all texts in order.  A serial
    digest: texts pass through one task as a sorted stream, and none is held."""
    import hashlib

    schema = "members long, digest string"
    if rows.isEmpty():  # Spark runs no task over no rows
        return rows.sparkSession.createDataFrame([(0, "sha256:" + hashlib.sha256(b"[]").hexdigest())], schema)

    def digest(batches):
        h, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for text in batch.column("e").to_pylist():
                h.update((b"," if n else b"") + text.encode())
                n += 1
        h.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array(["sha256:" + h.hexdigest()])], names=["members", "digest"])

    # One task sorts, spilling to disk: coalescing sorted ranges would not promise their order.
    sorted_ = rows.select(F.col(encoded).alias("e"), *[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    sorted_ = sorted_.repartition(1).sortWithinPartitions(*[f"o{i}" for i in range(len(order))])
    return sorted_.select("e").mapInArrow(digest, schema)

"""Layers: immutable tables named by a manifest of Parquet folders, changed by deltas.

A manifest lists parts in order; a part has rows, and a delta part also kills the keys it
holds, and those in its tombstone folder, in all parts before it.  Layers share parts, so
a change writes what changed alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.text import bucket
from ..operators.guards import audited, refuse_any, unique, where_in
from .control import Files, digest, require

MOST_PAYLOAD = 8 << 20
#: A chain of deltas is rewritten beyond this many parts.
MOST_PARTS = 16
ENCODED = T.StructType([T.StructField(n, k) for n, k in (("record_identity", T.StringType()), ("partition_value", T.StringType()), ("record_json", T.StringType()), ("bucket", T.IntegerType()))])


@dataclass(frozen=True)
class Layer:
    id: str
    kind: str
    schema: T.StructType
    key: tuple[str, ...]
    parts: tuple[dict, ...]


class LayerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # --- manifests -----------------------------------------------------------------

    def _publish(self, kind: str, schema: T.StructType, key: tuple[str, ...], parts: list[dict]) -> Layer:
        body = {"kind": kind, "schema": schema.jsonValue(), "key": list(key), "parts": parts}
        name = digest(body)
        self.files.create(f"layers/{name}.json", body)
        return Layer(name, kind, schema, key, tuple(parts))

    def open(self, layer_id: str) -> Layer:
        require(self.files.exists(f"layers/{layer_id}.json"), f"no layer {layer_id}")
        body = self.files.read(f"layers/{layer_id}.json")
        require(digest(body) == layer_id, "a manifest differs from its name")
        return Layer(layer_id, body["kind"], T.StructType.fromJson(body["schema"]), tuple(body["key"]), tuple(body["parts"]))

    def _write(self, rows: DataFrame, sort_by: list[str]) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.sortWithinPartitions(*sort_by) if sort_by else rows
        rows.write.option("compression", "zstd").parquet(self.files.path(name))
        return name

    # --- writing -------------------------------------------------------------------

    def write(self, rows: DataFrame, *, kind: str, key: list[str] = (), sort_by: list[str] | None = None, check: bool = True) -> Layer:
        """A new layer; repeated or null keys refuse."""
        if key and check:
            refuse_any(rows.where(" or ".join(f"`{k}` is null" for k in key)), "a key is null")
            unique(rows, list(key))
        return self._publish(kind, rows.schema, tuple(key), [{"rows": self._write(rows, list(sort_by or key))}])

    def write_encoded(self, records: DataFrame, *, kind: str, buckets: int) -> Layer:
        """``record_identity, partition_value, record_json`` with its SHA-256 bucket."""
        rows = records.select("record_identity", "partition_value", "record_json", bucket("partition_value", buckets).alias("bucket"))
        audited(rows, "record_identity", "record_json", MOST_PAYLOAD)
        return self.write(rows.repartition("bucket"), kind=kind, key=["record_identity"], sort_by=["bucket", "record_identity"], check=False)

    def append(self, base: Layer, rows: DataFrame, *, exclude_existing: bool = False) -> Layer:
        """Rows with new keys as one more part; keys the base holds refuse or are left out."""
        rows = self._conform(rows, base)
        if base.key:
            old = self.relation(base).select(*base.key)
            if exclude_existing:
                rows = rows.join(old, list(base.key), "left_anti").select(*base.schema.names)
            else:
                refuse_any(rows.join(old, list(base.key), "left_semi"), "a key is held already")
            unique(rows, list(base.key))
        return self._publish(base.kind, base.schema, base.key, [*base.parts, {"rows": self._write(rows, list(base.key))}])

    def apply(self, base: Layer, puts: DataFrame, removed: DataFrame | None = None) -> Layer:
        """Replaces or adds ``puts`` and drops ``removed`` keys, as one delta."""
        puts = self._conform(puts, base)
        keys = list(base.key)
        require(bool(keys), "a layer without a key takes no changes")
        unique(puts, keys)
        part = {"rows": self._write(puts, keys), "kills": True}
        if removed is not None:
            refuse_any(removed.join(puts, keys, "left_semi"), "a key is put and removed")
            part["gone"] = self._write(removed.select(*keys).distinct(), keys)
        out = self._publish(base.kind, base.schema, base.key, [*base.parts, part])
        return self.compact(out, prove=False) if len(out.parts) > MOST_PARTS else out

    def replace_buckets(self, base: Layer, rows: DataFrame, buckets: list[int]) -> Layer:
        """Whole buckets of an encoded layer, anew."""
        refuse_any(rows.where(~F.col("bucket").isin(buckets)), "a row lies outside the replaced buckets")
        gone = self.relation(base).where(F.col("bucket").isin(buckets)).select("record_identity").join(rows.select("record_identity"), "record_identity", "left_anti")
        return self.apply(base, rows, gone)

    def compact(self, base: Layer, *, prove: bool = True) -> Layer:
        """One part with the same rows, compared with the old ones before it is published."""
        rows = self.relation(base)
        out = self._publish(base.kind, base.schema, base.key, [{"rows": self._write(rows, list(base.key))}])
        if prove:
            from functools import reduce

            a, b = rows.alias("a"), self.relation(out).alias("b")
            on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in base.key])
            unlike = reduce(lambda x, y: x | y, [~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in base.schema.names])
            refuse_any(a.join(b, on, "full_outer").where(unlike).select("a.*"), "a rewrite changed a row")
        return out

    def register(self, paths: list[str], *, kind: str, schema: T.StructType, key: list[str]) -> Layer:
        """Names Parquet files of a producer where they are, after their schema's check."""
        for p in paths:
            found = self.spark.read.parquet(p).schema
            require([(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema], f"{p} has another schema")
        layer = self._publish(kind, schema, tuple(key), [{"rows": p, "absolute": True} for p in paths])
        unique(self.relation(layer), key)
        return layer

    def _conform(self, rows: DataFrame, base: Layer) -> DataFrame:
        kinds = lambda s: {f.name: f.dataType for f in s}
        if kinds(rows.schema) != kinds(base.schema):
            raise Refused(f"rows of {rows.schema.simpleString()} do not fit {base.schema.simpleString()}")
        return rows.select(*base.schema.names)

    # --- reading -------------------------------------------------------------------

    def _part(self, name: str, schema: T.StructType, absolute: bool = False) -> DataFrame:
        return self.spark.read.schema(schema).parquet(name if absolute else self.files.path(name))

    def relation(self, layer: Layer, *, buckets: list[int] | None = None, ranges: list[tuple] | None = None) -> DataFrame:
        """The layer's rows: those of each part that no later part kills."""
        from ..operators.guards import in_ranges

        killers = [i for i, p in enumerate(layer.parts) if p.get("kills")]
        keys = list(layer.key)
        key_schema = T.StructType([layer.schema[k] for k in keys])
        rows = kills = None
        for i, p in enumerate(layer.parts):
            own = self._part(p["rows"], layer.schema, p.get("absolute", False))
            if buckets is not None:
                own = own.where(F.col("bucket").isin(buckets))
            if ranges is not None:
                own = own.where(in_ranges(F.col(keys[0]), ranges))
            if killers:
                own = own.withColumn("__part", F.lit(i))
            rows = own if rows is None else rows.unionByName(own)
            for name in ([p["rows"]] if p.get("kills") else []) + ([p["gone"]] if "gone" in p else []):
                k = self._part(name, layer.schema if name == p["rows"] else key_schema).select(*keys, F.lit(i).alias("__kill"))
                kills = k if kills is None else kills.unionByName(k)
        if kills is None:
            return rows
        last = kills.groupBy(*keys).agg(F.max("__kill").alias("__kill"))
        return rows.join(last, keys, "left").where("__kill is null or __part >= __kill").select(*layer.schema.names)

    def lookup(self, layer: Layer, values: DataFrame | list, column: str | None = None) -> DataFrame:
        return where_in(self.relation(layer), column or layer.key[0], values)

    def scan_files(self, layer: Layer) -> DataFrame:
        """Rows of all parts with the file that holds each."""
        out = None
        for p in layer.parts:
            own = self._part(p["rows"], layer.schema, p.get("absolute", False)).withColumn("file", F.col("_metadata.file_path"))
            out = own if out is None else out.unionByName(own)
        return out

    def invalid_rows(self, layer: Layer, buckets: int) -> DataFrame:
        """Rows of an encoded layer in a wrong bucket, without payload, or repeated."""
        rows = self.relation(layer)
        bad = (F.col("bucket") != bucket("partition_value", buckets)) | F.col("record_json").isNull()
        return rows.where(bad).select("record_identity").unionByName(rows.groupBy("record_identity").count().where("count > 1").select("record_identity"))

    def paths(self, layer: Layer) -> list[str]:
        return [n if p.get("absolute") else self.files.path(n) for p in layer.parts for n in (p["rows"], p.get("gone")) if n]

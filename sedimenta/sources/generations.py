"""Producer generations: tables published as Parquet members with a description, checked
before they are admitted."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..operators.guards import refuse_any
from .control import Files, digest, require


@dataclass(frozen=True)
class Generation:
    """A family's tables: ``{table: {"columns": {name: type}, "rows": n, "members":
    [{"key": path, "rows": n}], "partition": column or None}}``."""

    root: str
    family: str
    tables: dict
    pin: str


def resolve(spark: SparkSession, root: str, family: str, *, expected_pin: str | None = None) -> Generation:
    """The generation that the publication pointer names now; no payload is read."""
    files = Files(spark, root)
    body = files.read(files.read("current.json")["generation"])
    pin = digest(body)
    require(expected_pin in (None, pin), "the generation is not the pinned one")
    require(body.get("family") == family, "the generation is of another family")
    keys = [m["key"] for t in body["tables"].values() for m in t["members"]]
    require(len(set(keys)) == len(keys), "a member is listed twice")
    return Generation(root.rstrip("/"), family, body["tables"], pin)


def schema_of(description: dict) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in description["columns"].items()))


def table(spark: SparkSession, generation: Generation, name: str) -> DataFrame:
    """A table's rows from its members alone, with the declared schema."""
    d = generation.tables[name]
    paths = [f"{generation.root}/{m['key']}" for m in d["members"]]
    return spark.read.schema(schema_of(d)).option("recursiveFileLookup", "true").parquet(*paths)


def check_table(spark: SparkSession, generation: Generation, name: str) -> None:
    """Members have the declared columns, their row counts add up, and a split member's rows
    hold the value that its key spells."""
    d = generation.tables[name]
    declared = [(f.name, f.dataType) for f in schema_of(d)]
    for m in d["members"]:
        found = spark.read.option("recursiveFileLookup", "true").parquet(f"{generation.root}/{m['key']}").schema
        require([(f.name, f.dataType) for f in found] == declared, f"{m['key']} has other columns")
    require(sum(m["rows"] for m in d["members"]) == d["rows"], f"{name}'s members do not add up to its rows")
    rows = table(spark, generation, name).withColumn("__file", F.col("_metadata.file_path"))
    counts = {r["__file"]: r["n"] for r in rows.groupBy("__file").agg(F.count("*").alias("n")).toLocalIterator()}
    for m in d["members"]:
        own = sum(n for f, n in counts.items() if f.endswith(m["key"]))
        require(own == m["rows"], f"{m['key']} has {own} rows, not {m['rows']}")
    if d.get("partition"):
        c = d["partition"]
        for m in d["members"]:
            require(f"{name}/{c}=" in m["key"], f"{m['key']} does not spell its partition")
        spelled = F.url_decode(F.regexp_extract("__file", f"/{c}=([^/]*)/", 1))
        refuse_any(rows.where(~spelled.eqNullSafe(F.col(c).cast("string"))).select("__file", c), "a row lies in another partition's member")


def check_types(rows: DataFrame, contract: dict[str, str]) -> None:
    """Columns that a contract names have its types."""
    for name, kind in contract.items():
        if name not in rows.columns or rows.schema[name].dataType != T.StructType.fromDDL(f"x {kind}")["x"].dataType:
            raise Refused(f"column {name} is not {kind}")


def check_receipts(subjects: DataFrame, receipts: DataFrame, on: list[str]) -> None:
    """Every subject matches exactly one accepted receipt, and none is left over."""
    accepted = receipts.where("accepted").groupBy(*on).agg(F.count("*").alias("receipts"))
    wanted = subjects.groupBy(*on).agg(F.count("*").alias("subjects"))
    joined = wanted.join(accepted, on, "full_outer")
    refuse_any(joined.where(~F.col("subjects").eqNullSafe(F.col("receipts")) | (F.col("receipts") != 1)), "subjects and receipts do not match one to one")


def footers(paths: list[str]) -> list[dict]:
    """Rows, columns, row groups and column statistics of local Parquet files, without data."""
    out = []
    for p in paths:
        meta = pq.read_metadata(p)
        stats: dict = {}
        for g in range(meta.num_row_groups):
            for i in range(meta.num_columns):
                c = meta.row_group(g).column(i)
                s = c.statistics
                own = stats.setdefault(c.path_in_schema, {"min": None, "max": None, "nulls": 0})
                if s is not None and s.has_min_max:
                    own["min"] = s.min if own["min"] is None else min(own["min"], s.min)
                    own["max"] = s.max if own["max"] is None else max(own["max"], s.max)
                own["nulls"] += (s.null_count or 0) if s is not None else 0
        sizes = [meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)]
        out.append({"path": p, "rows": meta.num_rows, "columns": meta.schema.names, "row_groups": sizes, "bytes": sum(sizes), "statistics": stats})
    return out

"""Refusals as queries: each asks for one offending row and stops the call if there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused


def refuse_any(rows: DataFrame, what: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise Refused(f"{what}: {found[0].asDict()}")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows hold, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(rows: DataFrame, keys: list[str], what: str = "a key is repeated") -> None:
    refuse_any(duplicates(rows, keys), what)


def audit(rows: DataFrame, identity: str, payload: str) -> DataFrame:
    """One row: rows, distinct identities, largest payload, whether anything is null."""
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct(identity).alias("identities"), F.max(F.octet_length(payload)).cast("long").alias("largest"),
        F.bool_or(F.col(identity).isNull() | F.col(payload).isNull()).alias("any_null"),
    )


def audited(rows: DataFrame, identity: str, payload: str, most: int) -> int:
    """Rows of a layer that passes its audit, in one pass."""
    a = audit(rows, identity, payload).first()
    if a.any_null or a.identities != a.rows or (a.largest or 0) > most:
        raise Refused(f"a layer breaks its rules: {a.asDict()}")
    return a.rows


def where_in(rows: DataFrame, column: str, values: DataFrame | list, inline: int = 256) -> DataFrame:
    """Rows whose ``column`` is among ``values``: a short list is a pushed-down IN, anything
    else a semi-join that Spark plans by size."""
    if isinstance(values, list):
        if len(values) <= inline:
            return rows.where(F.col(column).isin(values))
        kind = rows.schema[column].dataType.simpleString()
        values = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {kind}")
    return rows.join(values.select(column).distinct(), column, "left_semi")


def in_ranges(column: Column, ranges: list[tuple]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | column.between(low, high)
    return out

"""Canonical spelling of typed rows, member keys and the identities made of them."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from .json import SAFE_INTEGER, json_array, json_string
from .text import NAMESPACE

VOLATILE = re.compile(r"(?:^|_)(?:observed|fetched)_at$", re.IGNORECASE)


@F.pandas_udf(T.StringType())
def double_text(x: pd.Series) -> pd.Series:
    """Shortest text that reads back as the number; ``nan`` whatever its sign."""
    return pd.Series([None if v is None else "nan" if v != v else repr(float(v)) for v in x.astype(object).where(x.notna() | (x != x), None)], dtype=object)


@F.arrow_udf(T.ArrayType(T.StringType()))
def doubles_text(x: pa.Array) -> pa.Array:
    """The same of arrays, which a function inside ``transform`` cannot do; nulls stay."""
    one = lambda v: None if v is None else "nan" if v != v else repr(v)
    return pa.array([None if vs is None else [one(v) for v in vs] for vs in x.to_pylist()], pa.list_(pa.string()))


def _double(c: Column) -> Column:
    return F.when(c.isNull(), None).when(F.isnan(c), F.lit("nan")).otherwise(double_text(F.when(~F.isnan(c), c)))


def _instant(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def cell(c: Column, kind: T.DataType) -> Column:
    """JSON text of one value; null spells ``null``."""
    if isinstance(kind, T.StringType):
        text = json_string(c)
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, T.LongType):
        text = F.when((c > SAFE_INTEGER) | (c < -SAFE_INTEGER), F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        text = c.cast("string")
    elif isinstance(kind, T.DoubleType):
        text = F.concat(F.lit('"'), _double(c), F.lit('"'))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, T.TimestampNTZType):
        text = F.concat(F.lit('"'), _instant(c), F.lit('"'))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit('"'), _instant(F.to_utc_timestamp(c, F.current_timezone())), F.lit('"'))
    elif isinstance(kind, T.DecimalType):
        text = F.concat(F.lit('"'), F.when(c == 0, F.abs(c)).otherwise(c).cast("string"), F.lit('"'))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType):
        quoted = F.transform(doubles_text(c), lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null")))
        text = F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))
    elif isinstance(kind, T.ArrayType):
        if "double" in kind.elementType.simpleString():
            raise Refused("doubles deep inside arrays have no spelling here")
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: cell(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        text = _object({f.name: cell(c[f.name], f.dataType) for f in kind})
    else:
        raise Refused(f"{kind.simpleString()} has no canonical spelling")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))


def _object(parts: dict[str, Column]) -> Column:
    import json

    names = sorted(parts, key=lambda n: n.encode("utf-16-be"))
    spelled = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), parts[n]) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *spelled), F.lit("}"))


def row_json(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """Canonical JSON of a row: keys in UTF-16 order, nulls spelled out."""
    names = columns or schema.names
    folded = [n.casefold() for n in names]
    if len(set(folded)) != len(folded):
        raise Refused("column names differ in case alone")
    return _object({n: cell(F.col(f"`{n}`"), schema[n].dataType) for n in names})


def differ(schema: T.StructType, left: str, right: str, columns: list[str]) -> Column:
    """Whether two rows (aliases) differ: null-safe per column, with 0.0 and -0.0 apart."""

    def one(name: str) -> Column:
        a, b = F.col(f"{left}.`{name}`"), F.col(f"{right}.`{name}`")
        kind = schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.StructType)):
            return cell(a, kind) != cell(b, kind)
        unlike = ~a.eqNullSafe(b)
        return unlike | F.coalesce((a == 0) & (b == 0) & (a.cast("string") != b.cast("string")), F.lit(False)) if isinstance(kind, T.DoubleType) else unlike

    return reduce(lambda x, y: x | y, [one(n) for n in columns], F.lit(False))


def volatile_columns(names: list[str]) -> list[str]:
    """Columns that say when a row was seen: they would give an unchanged row a new identity."""
    return [n for n in names if VOLATILE.search(n)]


# --- member keys -------------------------------------------------------------------


def _refuse(bad: Column, say: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(say)).cast("string")).otherwise(value)


def _component(c: Column, kind: T.DataType) -> Column:
    return F.date_format(c, "yyyy-MM-dd") if isinstance(kind, T.DateType) else c.cast("string")


def key_value(schema: T.StructType, name: str) -> Column:
    text = _component(F.col(name), schema[name].dataType)
    return _refuse(text.isNull() | (text == ""), "a member key is null or empty", text)


def key_at_joined(schema: T.StructType, names: list[str]) -> Column:
    """Two or more components joined by ``@``; none may be null, empty or hold an ``@``."""
    if len(names) < 2:
        raise Refused("an at-joined key has two or more components")
    parts = [_component(F.col(n), schema[n].dataType) for n in names]
    bad = reduce(lambda x, y: x | y, [p.isNull() | (p == "") | p.contains("@") for p in parts])
    return _refuse(bad, "a key component is null, empty or holds @", F.concat_ws("@", *parts))


def key_number_date(schema: T.StructType, number: str, day: str) -> Column:
    """``number@date``; the number may hold an ``@``, the date is the last part."""
    parts = [_component(F.col(n), schema[n].dataType) for n in (number, day)]
    bad = parts[0].isNull() | (parts[0] == "") | parts[1].isNull() | (parts[1] == "")
    return _refuse(bad, "a key component is null or empty", F.concat_ws("@", *parts))


def key_tuple(schema: T.StructType, names: list[str]) -> Column:
    """A canonical JSON array of strings and nulls."""
    return json_array([json_string(_component(F.col(n), schema[n].dataType)) for n in names])


def key_segment(member: Column, index: Column) -> Column:
    return _refuse(member.isNull() | (member == "") | index.isNull(), "a segment key is incomplete", F.concat(member, F.lit("#"), index.cast("string")))


def split_segment_key(key: Column) -> Column:
    """struct(member, index), cut at the last ``#``."""
    last = F.substring_index(key, "#", -1)
    return F.struct(F.left(key, F.char_length(key) - F.char_length(last) - 1).alias("member"), last.cast("long").alias("index"))


def at_splits(key: str, parts: int) -> list[tuple[str, ...]]:
    """Every component tuple that an at-joined key of ``parts`` parts could spell."""
    pieces = key.split("@")
    if parts == 1:
        return [(key,)]
    out = []
    for i in range(1, len(pieces) - parts + 2):
        out += [("@".join(pieces[:i]), *rest) for rest in at_splits("@".join(pieces[i:]), parts - 1)]
    return out


# --- identities ------------------------------------------------------------------------


def occurrence_hash(family: str, table: str, key: Column, row_digest: Column) -> Column:
    """SHA-256 of the canonical ``[family, table, key, "sha256:<row digest>"]``."""
    import json

    head = f"[{json.dumps(family, ensure_ascii=False)},{json.dumps(table, ensure_ascii=False)},"
    return F.sha2(F.concat(F.lit(head), json_string(key), F.lit(',"sha256:'), row_digest, F.lit('"]')), 256)


def occurrence_urn(hash_: Column) -> Column:
    return F.concat(F.lit(f"{NAMESPACE}:table-occurrence:v1:"), hash_)


def identities(rows: DataFrame, family: str, table: str, key: Column, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with ``member_key, row_digest, occurrence_hash``."""
    keyed = rows.withColumn("member_key", key).withColumn("row_digest", F.sha2(row_json(rows.schema, columns), 256))
    return keyed.withColumn("occurrence_hash", occurrence_hash(family, table, F.col("member_key"), F.col("row_digest")))

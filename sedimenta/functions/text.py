"""Text expressions: digests, orders, normalisers and counts, all JVM-side unless a
function's name says ``udf``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters that end a word (and that trimming drops).
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Fixed value: what ends a line.
LINE_END = r"(?:\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}])"

NAMESPACE = "urn:sedimenta"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- digests --------------------------------------------------------------


def sha256_digest(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(c).cast("binary"), 256))


def stable_urn(kind: str, c: Column | str, version: int = 1) -> Column:
    """A name made of the digest of canonical bytes."""
    return F.concat(F.lit(f"{NAMESPACE}:{kind}:v{version}:"), F.sha2(col(c).cast("binary"), 256))


def bucket(c: Column | str, count: int) -> Column:
    """First 8 bytes of the SHA-256, big-endian, modulo ``count``."""
    head = F.conv(F.substring(F.sha2(col(c).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(count).cast("decimal(20,0)")).cast("int")


# --- orders and counts ------------------------------------------------------


def utf16_key(c: Column | str) -> Column:
    """Sorts text by UTF-16 code units.  Text with a lone surrogate cannot be stored as
    UTF-8, so none reaches a column."""
    return F.encode(col(c), "UTF-16BE")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(f"[^{SPACE}]+")).cast("long")


def line_count(c: Column | str) -> Column:
    """Lines as a text editor counts them: an end of line at the very end opens none."""
    c = col(c)
    ends = F.regexp_count(c, F.lit(LINE_END))
    open_ = F.when((c == "") | c.rlike(f"(?s){LINE_END}\\z"), 0).otherwise(1)
    return (ends + open_).cast("long")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def content_statistics(content: Column | str) -> list[Column]:
    """Five columns about a segment's bytes; the text ones are null unless it is UTF-8."""
    raw = col(content).cast("binary")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return [
        sha256_digest(raw).alias("content_digest"), F.octet_length(raw).cast("long").alias("byte_count"),
        F.char_length(text).cast("long").alias("codepoint_count"), line_count(text).alias("line_count"), word_count(text).alias("word_count"),
    ]


# --- normalisers ---------------------------------------------------------
# Each returns struct(value, unparseable): rejected input is kept, null is neither.


def _outcome(c: Column, value: Column) -> Column:
    return F.struct(value.alias("value"), F.when(c.isNotNull() & value.isNull(), F.array(c.cast("string"))).otherwise(F.array().cast("array<string>")).alias("unparseable"))


def text_value(c: Column | str) -> Column:
    c = col(c)
    return _outcome(c, F.when(strip(c) != "", c))


def iso_date(c: Column | str) -> Column:
    """The first ten characters if they are a calendar date."""
    head = F.substring(col(c), 1, 10)
    real = F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (F.substring(head, 1, 4) != "0000") & (F.date_format(real, "yyyy-MM-dd") == head), head)


def date_value(c: Column | str) -> Column:
    c = col(c)
    return _outcome(c, iso_date(c))


def utc_instant_date(c: Column | str) -> Column:
    """The date of an instant spelled to the second with a Z, and nothing else."""
    c = col(c)
    clock = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z")
    return _outcome(c, F.when(clock, iso_date(c)))


def http_url(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.rlike(r"^(?i:https?)://[^/?#]+"), c)


def media_type(c: Column | str) -> Column:
    """The type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(col(c), ";", 1)))


def string_set(values: Column | str) -> Column:
    """struct(values, unparseable) of an array: distinct non-empty strings in UTF-16 order."""
    values = F.coalesce(col(values), F.array().cast("array<string>"))
    good = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    keyed = F.array_sort(F.transform(good, lambda x: F.struct(F.encode(x, "UTF-16BE").alias("k"), x.alias("v"))))
    return F.struct(F.transform(keyed, lambda s: s["v"]).alias("values"), F.filter(values, lambda x: x.isNull() | (x == "")).alias("unparseable"))


@F.pandas_udf(T.StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def rin(c: Column | str) -> Column:
    """A regulation identifier: NFKC, upper case, ``0000-AA00``."""
    value = F.upper(nfkc_udf(strip(c)))
    return F.when(value.rlike(r"^[0-9]{4}-[A-Z][A-Z0-9]{3}\z"), value)


def normalization_outcome(value: Column, unparseable: Column, present: Column | None = None) -> Column:
    """Rejected input outranks a value, which outranks absence."""
    there = value.isNotNull() if present is None else present
    return F.when(F.size(unparseable) > 0, "unparseable").when(there, "normalized").otherwise("absent")


def observed_topics(values: Column | str, scheme: str, *, identity_fields: tuple[str, ...] = (), label_fields: tuple[str, ...] = ()) -> Column:
    """Distinct struct(id, scheme, label), in UTF-16 order, of an array of strings, or of
    structs by their first non-empty fields.  Reserved namespaces refuse."""
    reserved = r"^urn:ref(spec)?:"
    first = lambda x, fields: F.coalesce(*[F.when(x[f] != "", x[f]) for f in fields])
    if label_fields:
        pairs = F.transform(col(values), lambda x: F.struct(F.coalesce(first(x, identity_fields), first(x, label_fields)).alias("id"), first(x, label_fields).alias("label")))
    else:
        pairs = F.transform(col(values), lambda x: F.struct(F.when(x != "", x).alias("id"), F.when(x != "", x).alias("label")))
    whole = F.filter(pairs, lambda p: p["id"].isNotNull() & p["label"].isNotNull())
    bad = F.lit(scheme).rlike(reserved) | F.exists(whole, lambda p: p["id"].rlike(reserved))
    checked = F.when(bad, F.raise_error(F.lit("a topic claims a reserved namespace")).cast("array<struct<id:string,label:string>>")).otherwise(whole)
    keyed = F.array_sort(F.array_distinct(F.transform(checked, lambda p: F.struct(F.encode(p["id"], "UTF-16BE").alias("a"), F.encode(p["label"], "UTF-16BE").alias("b"), p["id"].alias("id"), p["label"].alias("label")))))
    return F.transform(keyed, lambda p: F.struct(p["id"].alias("id"), F.lit(scheme).alias("scheme"), p["label"].alias("label")))

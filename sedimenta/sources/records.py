"""Keyed JSON lines, supplied records, content-addressed bytes, fetched files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256_digest, utf16_key
from ..operators.guards import refuse_any, unique

MOST_ROW = 8 << 20


def keyed_json_lines(spark: SparkSession, path: str, most: int = MOST_ROW) -> DataFrame:
    """``member_key, value`` of ``{"key": ..., "value": ...}`` lines; values as canonical
    text.  Longer lines and other shapes refuse."""
    from ..functions.json import canonical_udf

    lines = spark.read.text(path)
    refuse_any(lines.where(F.octet_length("value") > most).select(F.octet_length("value").alias("bytes")), "a line is too long")
    v = lines.select(F.try_parse_json("value").alias("v"), "value")
    key = F.try_variant_get("v", "$.key", "string")
    shaped = v.select(key.alias("member_key"), F.to_json(F.try_variant_get("v", "$.value", "variant")).alias("value"), F.schema_of_variant("v").alias("shape"))
    refuse_any(shaped.where("member_key is null or shape is null or not shape rlike '^OBJECT<key: STRING, value: '"), "a line is not a keyed value")
    return shaped.select("member_key", canonical_udf("value").alias("value"))


def supplied_records(rows: DataFrame, item: str) -> DataFrame:
    """A caller's records in UTF-16 order of their id; repeated ids refuse."""
    unique(rows, [item])
    return rows.orderBy(utf16_key(item))


def content_table(rows: DataFrame, content: str) -> DataFrame:
    """``digest, size, content``: each distinct content once."""
    each = rows.select(F.col(content).cast("binary").alias("content")).where("content is not null")
    return each.select(sha256_digest("content").alias("digest"), F.octet_length("content").cast("long").alias("size"), "content").dropDuplicates(["digest"])


def broken_content(table: DataFrame) -> DataFrame:
    """Rows whose bytes are not what digest and size say."""
    return table.where((sha256_digest("content") != F.col("digest")) | (F.octet_length("content") != F.col("size"))).select("digest")


def byte_range(table: DataFrame, start: int, end: int) -> DataFrame:
    return table.select("digest", F.substring("content", start + 1, end - start).alias("bytes"))


def captured_files(spark: SparkSession, pattern: str, *, most: int = 64 << 20) -> DataFrame:
    """``locator, size, content_digest, content`` of files; a larger one refuses."""
    files = spark.read.format("binaryFile").load(pattern)
    refuse_any(files.where(F.col("length") > most).select("path", "length"), "a file is too large")
    return files.select(F.col("path").alias("locator"), F.col("length").alias("size"), sha256_digest("content").alias("content_digest"), "content")


def fetch(candidates: DataFrame, fetchers: dict, *, most: int = 64 << 20) -> DataFrame:
    """``locator, content, problem`` through a fetcher per URL scheme, called on the
    executors as ``fetcher(locator, most) -> bytes``."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for locator in pdf["locator"]:
                scheme = (locator or "").partition("://")[0]
                try:
                    data = fetchers[scheme](locator, most)
                    out.append((locator, data, None) if len(data) <= most else (locator, None, "larger than its bound"))
                except KeyError:
                    out.append((locator, None, f"no fetcher for {scheme}"))
                except OSError as error:
                    out.append((locator, None, str(error)))
            yield pd.DataFrame(out, columns=["locator", "content", "problem"])

    return candidates.select("locator").mapInPandas(run, "locator string, content binary, problem string")

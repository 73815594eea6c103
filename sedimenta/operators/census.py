"""Censuses: coverage, field shapes, rates with intervals, digests of multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def nearest_rank(rows: DataFrame, group: list[str], value: str, fractions: list[float]) -> DataFrame:
    """Exact nearest-rank percentiles per group: the value at rank ceil(p * n).  Values are
    counted first, so a group costs its distinct values."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy(value)
    ranked = per.withColumn("__upto", F.sum("__n").over(w)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*group)))
    pick = lambda p: F.min(F.when(F.col("__upto") >= F.ceil(F.lit(p) * F.col("__all")), F.col(value)))
    return ranked.groupBy(*group).agg(*[pick(p).alias(f"p{round(p * 100)}") for p in fractions])


def text_coverage(rows: DataFrame, group: list[str], text: str) -> DataFrame:
    """Per group: rows, null, blank and present texts, and lengths by nearest rank."""
    c = F.col(text)
    blank = strip(c) == ""
    counts = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("null_rows"), F.count_if(blank).alias("blank_rows"), F.count_if(c.isNotNull() & ~blank).alias("present_rows"))
    lengths = nearest_rank(rows.where(c.isNotNull() & ~blank).withColumn("__len", F.char_length(c)), group, "__len", [0.5, 0.9, 0.99])
    return counts.join(lengths, group, "left")


def field_census(rows: DataFrame, json_text: str, pointers: dict[str, str]) -> DataFrame:
    """Per named path of a JSON column: present, non-null, kinds of values, distinct texts
    (approximate), largest text, non-ASCII and control texts."""
    from ..functions.json import selected

    parsed = rows.select(F.parse_json(F.col(json_text)).alias("__v"))
    each = parsed.select(F.explode(F.array(*[F.struct(F.lit(name).alias("field"), selected("__v", p).alias("s")) for name, p in pointers.items()])).alias("x"))
    x = each.select("x.field", "x.s.state", "x.s.kind", "x.s.value")
    per_kind = x.where("kind is not null").groupBy("field", "kind").agg(F.count("*").alias("n")).groupBy("field").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    counts = x.groupBy("field").agg(
        F.count_if(F.col("state") == "present").alias("present"), F.count_if(F.col("kind").isNotNull() & (F.col("kind") != "VOID")).alias("non_null"),
        F.count_if(F.col("value").isNotNull() & ~F.col("value").isin('""', "null", "[]", "{}")).alias("non_empty"), F.approx_count_distinct("value").alias("distinct_values"),
        F.max(F.octet_length("value")).alias("largest"), F.count_if(F.col("value").rlike(r"[^\x00-\x7F]")).alias("non_ascii"), F.count_if(F.col("value").rlike(r"\\u00[01][0-9a-fA-F]|\\[bfnrt]")).alias("control"),
    )
    return counts.join(per_kind, "field", "left")


def phrase_prevalence(rows: DataFrame, unit: str, predicates: dict[str, Column]) -> DataFrame:
    """Per predicate the rows and the distinct units where it holds."""
    each = rows.select(F.col(unit).alias("__u"), F.explode(F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))).alias("predicate"))
    return each.groupBy("predicate").agg(F.count("*").alias("rows"), F.count_distinct("__u").alias("units"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of k successes among n."""
    p, zz = k / n, z * z
    middle = p + zz / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (middle - half) / (1 + zz / n), (middle + half) / (1 + zz / n)


def rates(rows: DataFrame, group: list[str], success: Column) -> DataFrame:
    """``n, k, rate, low, high`` per group."""
    per = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(success).alias("k"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return per.select(*group, "n", "k", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def weighted_rate(cells: DataFrame, weight: str, k: str, n: str) -> DataFrame:
    return cells.agg((F.sum(F.col(weight) * F.col(k)) / F.sum(F.col(weight) * F.col(n))).alias("rate"))


def out_of_order(rows: DataFrame, part: str, position: str, key: str) -> DataFrame:
    """``disordered``: rows of a file whose key is not above the one before."""
    before = F.lag(key).over(Window.partitionBy(part).orderBy(position))
    return rows.select(before.alias("b"), F.col(key).alias("k")).agg(F.count_if(F.col("b") >= F.col("k")).alias("disordered"))


def row_group_rows(rows: DataFrame, position: str, width: str, target: int) -> int:
    """Rows a group such that the widest group of consecutive rows stays within ``target``
    bytes: a search over sizes, each one aggregate."""
    total = rows.agg(F.count("*").alias("n")).first().n
    low, high = 1, max(1, total)
    while low < high:
        middle = (low + high + 1) // 2
        widest = rows.groupBy(F.floor(F.col(position) / middle).alias("g")).agg(F.sum(width).alias("w")).agg(F.max("w").alias("w")).first().w
        low, high = (middle, high) if (widest or 0) <= target else (low, middle - 1)
    return low


def anomalies(text: Column, title: Column) -> Column:
    """Names of what is odd about a drawn text."""
    flags = {
        "entity": text.rlike(r"&(?:[A-Za-z]+|#[0-9]+);"), "markup": text.rlike(r"</?[A-Za-z][^>]*>"), "equals-title": text == title,
        "control": text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "upper-case": text.rlike(r"[A-Z]") & ~text.rlike(r"[a-z]"), "edge-space": text != strip(text),
    }
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))

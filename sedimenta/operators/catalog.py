"""Source catalogs: exact joins on unique indexes, deterministic samples, ordered
decisions, and the accounts of all three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from .guards import refuse_any, unique
from .states import positions

# --- indexes and joins -------------------------------------------------------


def unique_index(rows: DataFrame, key: Column) -> DataFrame:
    """``lookup_key`` and the row (``row``) of keys that exactly one row names: a key that
    several rows name is not indexed at all."""
    keyed = rows.select(key.alias("lookup_key"), F.struct(*rows.columns).alias("row")).where("lookup_key is not null")
    return keyed.groupBy("lookup_key").agg(F.count("*").alias("n"), F.first("row").alias("row")).where("n = 1").select("lookup_key", "row")


def index_counts(rows: DataFrame, key: Column) -> DataFrame:
    """One row: rows indexed, rows whose key others share, rows without a key."""
    per = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    there = F.col("k").isNotNull()
    return per.agg(total(there & (F.col("n") == 1)).alias("indexed"), total(there & (F.col("n") > 1)).alias("ambiguous"), total(~there).alias("unkeyed"))


def exact_join(rows: DataFrame, source: Column, index: DataFrame, name: str) -> DataFrame:
    """Adds struct ``name`` (join, source_value, outcome, matched key): not-stated for a null
    value, no-match, or matched."""
    keys = index.select(F.col("lookup_key").alias("__k")).distinct()
    joined = rows.withColumn("__s", source).join(keys, F.col("__s") == F.col("__k"), "left")
    outcome = F.when(F.col("__s").isNull(), "not-stated").when(F.col("__k").isNull(), "no-match").otherwise("matched")
    return joined.withColumn(name, F.struct(F.lit(name).alias("join"), F.col("__s").alias("source_value"), outcome.alias("outcome"), F.col("__k").alias("matched"))).drop("__s", "__k")


def join_coverage(outcomes: DataFrame) -> DataFrame:
    """``join, eligible, matched, unmatched, null_result`` of rows ``(join, outcome)``."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("join").agg((n("matched") + n("no-match")).alias("eligible"), n("matched").alias("matched"), n("no-match").alias("unmatched"), n("not-stated").alias("null_result"))


def refuse_collapsed(coverage: DataFrame, least: int = 10_000) -> None:
    """A join that many rows could make and none does is a broken join."""
    refuse_any(coverage.where((F.col("eligible") >= least) & (F.col("matched") == 0)), "a join matches nothing")


def owned_records(rows: DataFrame, item: str, docket: str, agency: str) -> DataFrame:
    """Of filings that share an id, the one that owns it: the id begins with its docket and
    a dash, the docket with its agency.  Without exactly one owner the call refuses.  Adds
    ``other_filings``, the number of rows given up."""
    owns = F.col(item).startswith(F.concat(F.col(docket), F.lit("-"))) & F.col(docket).startswith(F.col(agency))
    marked = rows.withColumn("__owns", F.coalesce(owns, F.lit(False)))
    per = marked.groupBy(item).agg(F.count("*").alias("__n"), F.count_if("__owns").alias("__owners"))
    refuse_any(per.where("__n > 1 and __owners <> 1"), "filings of one id have no single owner")
    return marked.join(per, item).where("__n = 1 or __owns").withColumn("other_filings", F.col("__n") - 1).drop("__owns", "__n", "__owners")


# --- samples ---------------------------------------------------------------------


def stratified_sample(rows: DataFrame, *, item: str, partition: str, strata: list[Column], seed: str, limit: int, tie: str | None = None) -> DataFrame:
    """Per partition the ``limit`` rows of lowest rank / sqrt(stratum size), where a row's
    rank in its stratum is by md5 of ``id:seed``; adds ``sample_rank, sample_score``."""
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.col(item).cast("string"), F.lit(seed))))
    for i, s in enumerate(strata):
        hashed = hashed.withColumn(f"__s{i}", F.coalesce(s.cast("string"), F.lit("(unknown)")))
    stratum = [partition, *[f"__s{i}" for i in range(len(strata))]]
    ranked = hashed.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*stratum).orderBy("__h", item)))
    sizes = hashed.groupBy(*stratum).agg(F.count("*").alias("__n"))
    on = reduce(lambda a, b: a & b, [ranked[c].eqNullSafe(sizes[c]) for c in stratum])
    # No stratum gives more than ``limit`` rows, so ranks beyond it never count.
    scored = ranked.where(F.col("sample_rank") <= limit).join(sizes, on).select(*[ranked[c] for c in ranked.columns], (F.col("sample_rank") / F.sqrt("__n")).alias("sample_score"))
    order = Window.partitionBy(partition).orderBy("sample_score", "__h", item, *([tie] if tie else []))
    picked = scored.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit)
    return picked.drop("__h", "__r", *[f"__s{i}" for i in range(len(strata))])


def largest_remainder(groups: DataFrame, total: int, weight: str, *, within: list[str], order: str) -> DataFrame:
    """Adds ``quota``: at least one per group and ``total`` in all (per ``within``) by the
    largest remainders of proportional shares, none above the group's weight."""
    part = Window.partitionBy(*within)
    share = F.lit(total) * F.col(weight) / F.sum(weight).over(part)
    floors = groups.withColumn("__share", share).withColumn("__base", F.greatest(F.floor("__share"), F.lit(1)))
    left = F.greatest(F.lit(total) - F.sum("__base").over(part), F.lit(0))
    place = F.row_number().over(part.orderBy((F.col("__share") - F.floor("__share")).desc(), F.col(order)))
    quota = F.least(F.col("__base") + F.when(place <= F.col("__left"), 1).otherwise(0), F.col(weight))
    return floors.withColumn("__left", left).withColumn("quota", quota.cast("long")).drop("__share", "__base", "__left")


def salted_sample(rows: DataFrame, *, item: str, within: str, group: str, salt: str, total: int) -> DataFrame:
    """Per ``within`` a sample of about ``total`` rows over its groups in proportion, lowest
    sha256(salt NUL id) first; adds ``design_weight`` = population / drawn."""
    sizes = rows.groupBy(within, group).agg(F.count("*").alias("population"))
    quotas = largest_remainder(sizes, total, "population", within=[within], order=group)
    ranked = rows.withColumn("__h", F.sha2(F.concat(F.lit(salt + "\0"), F.col(item).cast("string")), 256)).join(quotas, [within, group])
    order = Window.partitionBy(within, group).orderBy("__h", item)
    drawn = ranked.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("quota"))
    return drawn.withColumn("design_weight", F.col("population") / F.col("quota")).drop("__h", "__r")


def stratum_draws(rows: DataFrame, *, item: str, strata: dict[str, Column], salt: str, n: int) -> DataFrame:
    """The ``n`` rows of lowest sha256(salt NUL id) per predicate; predicates overlap, so a
    row can be drawn for several.  Adds ``stratum, draw``."""
    held = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in strata.items()]))
    each = rows.withColumn("stratum", F.explode(held)).withColumn("__h", F.sha2(F.concat(F.lit(salt + "\0"), F.col(item).cast("string")), 256))
    order = Window.partitionBy("stratum").orderBy("__h", item)
    return each.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n).drop("__h")


# --- decisions --------------------------------------------------------------------

DISPOSITIONS = ("selected", "excluded", "deleted", "unavailable", "failed")


def decide(rows: DataFrame, rules: list[tuple[str, Column, str, str]]) -> DataFrame:
    """Adds ``disposition, reason_code, decisions`` from (name, holds, disposition, code)
    rules in order: the first that fails decides, and decisions lists those up to it."""
    for _, _, disposition, _ in rules:
        if disposition not in DISPOSITIONS:
            raise Refused(f"unknown disposition {disposition}")
    broken = [~F.coalesce(holds, F.lit(False)) for _, holds, _, _ in rules]
    disposition, code = F.lit("selected"), F.lit(None).cast("string")
    for bad, (_, _, d, c) in reversed(list(zip(broken, rules, strict=True))):
        disposition, code = F.when(bad, d).otherwise(disposition), F.when(bad, c).otherwise(code)
    made, alive = [], F.lit(True)
    for bad, (name, _, _, _) in zip(broken, rules, strict=True):
        made.append(F.when(alive, F.struct(F.lit(name).alias("check"), (~bad).alias("passed"))))
        alive = alive & ~bad
    return rows.select("*", disposition.alias("disposition"), code.alias("reason_code"), F.array_compact(F.array(*made)).alias("decisions"))


def apply_budget(rows: DataFrame, passed: Column, order: Column, most: int) -> DataFrame:
    """Adds ``in_budget``: the first ``most`` rows that passed, in a global order.  Ranges
    of the order are counted first, so no task holds all rows."""
    placed = positions(rows.where(passed), order)
    placed = placed.withColumn("in_budget", F.col("position") < most).drop("position")
    return placed.unionByName(rows.where(~F.coalesce(passed, F.lit(False))).withColumn("in_budget", F.lit(False)))


def running_selected(rows: DataFrame, partition: list[str], order: list[Column], passed: Column) -> DataFrame:
    """Adds ``selected_so_far``: rows that passed up to and with this one."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("selected_so_far", F.sum(F.when(passed, 1).otherwise(0)).over(w))


def tally(rows: DataFrame) -> DataFrame:
    """``disposition, reason_code, n``."""
    return rows.groupBy("disposition", "reason_code").agg(F.count("*").alias("n"))


def reconcile(rows: DataFrame, claimed: DataFrame) -> None:
    """Claimed counts ``(disposition, n)`` equal the tallied ones."""
    own = rows.groupBy("disposition").agg(F.count("*").alias("n"))
    theirs = claimed.select("disposition", F.col("n").alias("claimed"))
    refuse_any(own.join(theirs, "disposition", "full_outer").where(~F.col("n").eqNullSafe(F.col("claimed"))), "an account does not add up")


def prefer_rendition(renditions: DataFrame, item: str, family: str, locator: str, families: list[str]) -> DataFrame:
    """Per item the first family, in order of preference, that has a locator: ``family,
    locators`` (distinct, in UTF-16 order)."""
    rank = F.array_position(F.array(*[F.lit(f) for f in families]), F.col(family))
    usable = renditions.where((rank > 0) & F.col(locator).isNotNull() & (F.col(locator) != "")).select(item, rank.alias("__r"), family, locator)
    per = usable.groupBy(item, "__r", family).agg(F.collect_set(F.struct(F.encode(F.col(locator), "UTF-16BE").alias("k"), F.col(locator).alias("l"))).alias("ls"))
    best = per.groupBy(item).agg(F.min_by(F.struct(family, "ls"), "__r").alias("best"))
    return best.select(item, F.col(f"best.{family}").alias("family"), F.transform(F.array_sort("best.ls"), lambda s: s["l"]).alias("locators"))


def candidate_kind(locator: Column, digest: Column, size: Column) -> Column:
    """``source-url`` without a digest, ``immutable-object`` with digest and size; a digest
    without a size or the reverse refuses."""
    uneven = digest.isNull() != size.isNull()
    return F.when(uneven, F.raise_error(F.lit("a candidate has a digest or a size alone")).cast("string")).when(locator.isNull(), None).when(digest.isNotNull(), "immutable-object").otherwise("source-url")


# --- explosions and previews --------------------------------------------------------


def normalized_field_rows(rows: DataFrame, item: str, fields: str) -> DataFrame:
    """One row per (item, field, value index) of an array of struct(field, outcome, values);
    a field without values is one row with a null index."""
    each = rows.select(item, F.explode(fields).alias("f"))
    return each.select(item, F.col("f.field").alias("field"), F.col("f.outcome").alias("outcome"), F.posexplode_outer("f.values").alias("value_index", "value"))


def numbered(rows: DataFrame, item: str, array: str, kind: str) -> DataFrame:
    """Elements of an array of structs, numbered per kind in their order."""
    each = rows.select(item, F.posexplode(array).alias("pos", "e"))
    order = Window.partitionBy(item, F.col(f"e.{kind}")).orderBy("pos")
    return each.select(item, F.col(f"e.{kind}").alias("kind"), F.row_number().over(order).alias("number"), "e")


def preview(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """``key, change, fields``: added, removed, changed (with the names of fields that
    differ) or unchanged."""
    unique(older, [key])
    unique(newer, [key])
    fields = [c for c in newer.columns if c != key]
    a, b = older.alias("a"), newer.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(unlike) > 0, "changed").otherwise("unchanged")
    out = joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), unlike.alias("fields"))
    return out.withColumn("fields", F.when(F.col("change") == "changed", F.col("fields")))


def preview_counts(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    return preview(older, newer, key).groupBy("change").agg(F.count("*").alias("n"))


def bounded_sample(rows: DataFrame, order: list[str], *, most_rows: int, most_bytes: int) -> list[dict]:
    """First rows while their canonical texts fit ``most_bytes``; a row too large for the
    rest is skipped, however many such rows come first.  Rows stream to the driver in order, a
    partition at a time, until the sample is full."""
    import json

    out, used = [], 0
    for row in rows.orderBy(*order).toLocalIterator():
        if len(out) == most_rows or used + 2 > most_bytes:  # no row's text is shorter
            break
        value = row.asDict(recursive=True)
        size = len(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode())
        if used + size <= most_bytes:
            out.append(value)
            used += size
    return out


def listing_items(listing: DataFrame, previous: DataFrame, *, key: str, dated: Column, dataset: str, wanted: list[str]) -> DataFrame:
    """A listing's objects as items: undated or unwanted ones are excluded, the others
    active; keys of the previous listing alone are deleted."""
    reason = F.when(~F.coalesce(dated, F.lit(False)), "undated").when(~F.col(dataset).isin(wanted), "out-of-scope")
    now = listing.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), "active").otherwise("excluded"))
    gone = previous.select(*listing.columns).join(listing.select(key), key, "left_anti").select(*listing.columns)
    return now.unionByName(gone.withColumn("reason", F.lit("missing")).withColumn("state", F.lit("deleted")))


def listing_coverage(items: DataFrame, dataset: str, size: str) -> DataFrame:
    active = F.col("state") == "active"
    return items.groupBy(dataset).agg(
        F.count("*").alias("objects"), F.sum(size).cast("long").alias("bytes"), F.count_if(active).alias("active_objects"),
        F.coalesce(F.sum(F.when(active, F.col(size))), F.lit(0)).cast("long").alias("active_bytes"),
    )

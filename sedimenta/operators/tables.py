"""Typed table states: row identities across generations, incremental derivation, lineage.

A generation is a DataFrame of declared columns.  ``identify`` adds ``member_key,
row_digest, occurrence_hash``; a membership is ``(member_key, occurrence_hash)``; the
minted index is ``(occurrence_hash, member_key, row_digest, first_state)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import rows as R
from .guards import refuse_any, unique


@dataclass(frozen=True)
class TableIdentity:
    """Names a table of a family and spells its members' keys."""

    family: str
    table: str
    key: Column
    columns: tuple[str, ...]

    def identify(self, rows: DataFrame) -> DataFrame:
        seen = R.volatile_columns(list(self.columns))
        if seen:
            raise Refused(f"columns change on unchanged rows: {seen}")
        out = R.identities(rows.select(*self.columns), self.family, self.table, self.key, list(self.columns))
        return out


def checked_identities(rows: DataFrame, identity: TableIdentity) -> DataFrame:
    """Identities of a generation whose keys are unique."""
    out = identity.identify(rows)
    unique(out, ["member_key"])
    return out


def changed_rows(new: DataFrame, old: DataFrame, columns: list[str], key: str = "member_key") -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks or whose columns differ; ``added`` tells which."""
    a, b = new.alias("n"), old.alias("o")
    joined = a.join(b, F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    missing = F.col(f"o.{key}").isNull()
    return joined.where(missing | R.differ(new.schema, "n", "o", columns)).select("n.*", missing.alias("added"))


def delta_counts(new: DataFrame, old: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """One row: carried, added, changed, removed rows of a new generation over an old one,
    and how many minted occurrences are generated (new to the index) or adopted."""
    minted = changed_rows(new, old, columns)
    fresh = minted.join(index.select("occurrence_hash").withColumn("known", F.lit(True)), "occurrence_hash", "left")
    m = fresh.agg(
        F.count("*").alias("minted"), F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("changed"),
        F.count_if(F.col("known").isNull()).alias("generated"), F.count_if(F.col("known")).alias("adopted"),
    )
    n, o = new.agg(F.count("*").alias("rows")), old.agg(F.count("*").alias("base"))
    # single rows side by side
    one = F.lit(1).alias("one")
    out = m.select("*", one).join(n.select("rows", one), "one").join(o.select("base", one), "one")
    return out.select((F.col("rows") - F.col("minted")).alias("carried"), "added", "changed", (F.col("base") + F.col("added") - F.col("rows")).alias("removed"), "generated", "adopted")


def advance_membership(base: DataFrame, new: DataFrame) -> DataFrame:
    """The membership after a generation: carried members keep their occurrence."""
    fresh = new.select("member_key", "occurrence_hash")
    carried = base.join(fresh, ["member_key", "occurrence_hash"], "left_semi")
    return carried.select("member_key", "occurrence_hash").unionByName(fresh.join(base, ["member_key", "occurrence_hash"], "left_anti"))


# --- minted index ---------------------------------------------------------------------


def append_occurrences(index: DataFrame, minted: DataFrame, state: str) -> DataFrame:
    """Index rows for the occurrences that the index lacks."""
    rows = minted.select("occurrence_hash", "member_key", "row_digest").dropDuplicates(["occurrence_hash"])
    return rows.join(index.select("occurrence_hash"), "occurrence_hash", "left_anti").withColumn("first_state", F.lit(state))


def lookup_occurrences(index: DataFrame, identity: TableIdentity, wanted: DataFrame) -> DataFrame:
    """Index rows of the wanted hashes; a hash that its row does not give refuses."""
    found = index.join(wanted.select("occurrence_hash").distinct(), "occurrence_hash", "left_semi")
    again = R.occurrence_hash(identity.family, identity.table, F.col("member_key"), F.col("row_digest"))
    refuse_any(found.where(again != F.col("occurrence_hash")), "an indexed occurrence does not match its row")
    return found


def key_pruned(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Rows that could have one of the at-joined keys: per column an IN list of the
    components that some split gives, which reaches the scan as a computed key cannot."""
    parts = [t for k in keys for t in R.at_splits(k, len(names))]
    out = rows
    for i, name in enumerate(names):
        kind = rows.schema[name].dataType
        texts = sorted({t[i] for t in parts})
        out = out.where(F.col(name).isin([F.try_to_date(F.lit(t)) if kind.simpleString() == "date" else F.lit(t).try_cast(kind) for t in texts]))
    return out


# --- derivation and lineage -----------------------------------------------------------


def derive_incremental(base: DataFrame, staged: DataFrame, removals: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(derived rows, one row of counts).  ``staged`` replaces all rows of the members it
    names, ``removals`` all rows of theirs; both are by ``member_key``; ``key`` names a row
    within the layer and ``occurrence_hash`` its content."""
    refuse_any(removals.join(staged, "member_key", "left_semi"), "a removed member has rows")
    unique(staged, key)
    touched = staged.select("member_key").unionByName(removals.select("member_key")).distinct()
    old = base.join(touched, "member_key", "left_semi")
    minted = staged.join(old.select(*key, "occurrence_hash"), [*key, "occurrence_hash"], "left_anti")
    same = staged.join(old.select(*key, "occurrence_hash"), [*key, "occurrence_hash"], "left_semi")
    gone = old.join(staged.select(*key), key, "left_anti")
    replaced = minted.join(old.select(*key), key, "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    counts = count(minted, "written").join(count(replaced, "replaced"), "one").join(count(gone, "removed"), "one").join(count(same, "unchanged"), "one").drop("one")
    return base.join(touched, "member_key", "left_anti").unionByName(staged.select(*base.columns)), counts


def affected_rows(derived: DataFrame, changed: DataFrame, lineage: str = "sources") -> DataFrame:
    """Derived rows whose lineage (an id or an array of ids) names a changed occurrence."""
    kind = derived.schema[lineage].dataType.simpleString()
    one = F.explode(lineage) if kind.startswith("array") else F.col(lineage)
    named = derived.select("member_key", one.alias("occurrence_id")).join(changed.select("occurrence_id").distinct(), "occurrence_id", "left_semi")
    return derived.join(named.select("member_key").distinct(), "member_key", "left_semi")


def membership_audit(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows and members that do not match each other."""
    a = rows.select("member_key", F.col("occurrence_hash").alias("row_hash"))
    b = membership.select("member_key", F.col("occurrence_hash").alias("member_hash"))
    return a.join(b, "member_key", "full_outer").where(~F.col("row_hash").eqNullSafe(F.col("member_hash")))


def spelled_payload(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean length of a row's canonical text."""
    return rows.agg(F.avg(F.octet_length(R.row_json(rows.schema, columns))).alias("mean_bytes"))


def set_digest(rows: DataFrame, column: str, groups: int = 256) -> DataFrame:
    """One order-free digest of distinct hex hashes: each group of leading hex digits is
    digested in its own order, and the groups' digests, in order, once more."""
    width = max(1, (groups - 1).bit_length() // 4)
    per = rows.select(column).distinct().groupBy(F.substring(column, 1, width).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda s: s["d"]), ""), 256).alias("set_digest"))

"""Source-native facts of catalog items: resolvers, explosions and filters, all as columns."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LimitExceeded
from ..functions import text
from .guards import refuse_any

#: A publisher's restriction, and the reason code it becomes.
WITHHELD = {
    "Copyrighted": "source.publisher-withheld.copyrighted",
    "Confidential Business Information": "source.publisher-withheld.confidential-business-information",
    "Personally Identifiable Information": "source.publisher-withheld.personally-identifiable-information",
    "Other": "source.publisher-withheld.other",
}
#: Codes of an unread restriction, and of none.
UNREAD, NO_CANDIDATE = "source.restrict-reason-unread", "source.no-candidate-rendition"

BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20

#: Microseconds from the day before 0001-01-01 to 1970-01-01.
_EPOCH = 719_163 * 86_400_000_000
_INSTANT = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6}0*)?)?(Z|[+-]\d{2}:?\d{2})\z"


def array_or_rejected(value: Column) -> tuple[Column, Column]:
    """(items, rejected) of JSON text: an array's members as JSON texts; null is no members;
    any other value, or text that is not JSON, is rejected whole."""
    parsed = F.try_parse_json(value)
    is_array = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    items = F.when(is_array, F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array().cast("array<string>"))
    empty = value.isNull() | F.coalesce(F.schema_of_variant(parsed) == "VOID", F.lit(False))
    return items, F.when(is_array | empty, F.array().cast("array<string>")).otherwise(F.array(value))


def agencies(entries: Column) -> tuple[Column, Column]:
    """(resolved, unparseable) of an array of ``(name, raw_name, slug, id)``: the slug names an
    agency, else its positive number; its label is the name, else the raw name.  Resolved
    ones are distinct, in UTF-16 order; null entries and a null array resolve to nothing."""
    some = lambda c: F.when(c != "", c)
    identity = lambda e: F.coalesce(some(e["slug"]), F.when(e["id"] > 0, F.concat(F.lit("federal-register:"), e["id"].cast("string"))))
    label = lambda e: F.coalesce(some(e["name"]), some(e["raw_name"]))
    known = lambda e: F.coalesce(identity(e).isNotNull() & label(e).isNotNull(), F.lit(False))
    keyed = F.transform(F.filter(entries, known), lambda e: F.struct(text.utf16_key(identity(e)).alias("k"), text.utf16_key(label(e)).alias("l"), identity(e).alias("agency_id"), label(e).alias("agency_name")))
    resolved = F.transform(F.array_sort(F.array_distinct(keyed)), lambda e: F.struct(e["agency_id"], e["agency_name"]))
    return F.coalesce(resolved, F.array().cast("array<struct<agency_id:string,agency_name:string>>")), F.filter(entries, lambda e: ~known(e))


def named_agency(rows: DataFrame, agency: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``agency_name`` by ``names(agency_id, agency_name)``, one row an id, and
    ``agency_unparseable``, the id that has no name there."""
    known = names.where("agency_name <> ''").select(F.col("agency_id").alias("__id"), "agency_name")
    joined = rows.join(known, F.col(agency) == F.col("__id"), "left").drop("__id")
    return joined.withColumn("agency_unparseable", F.when(F.col("agency_name").isNull(), F.col(agency)))


def withheld(declared: Column, subtype: Column, absent: Column) -> Column:
    """``(disposition, code, reason)`` of an item without a rendition, by what its publisher
    declares; ``absent``: the reason if it declares nothing."""
    code = F.create_map(*[F.lit(x) for pair in WITHHELD.items() for x in pair])[declared]
    said = F.concat(F.lit("The publisher withholds this record's content; restrictReasonType is '"), declared, F.lit("'"))
    full = F.concat(said, F.coalesce(F.when(subtype != "", F.concat(F.lit(" and subtype is '"), subtype, F.lit("'"))), F.lit("")), F.lit("."))
    unread = F.concat(F.lit("The publisher declares a restrictReasonType this policy does not read: '"), declared, F.lit("'."))
    row = lambda d, c, r: F.struct(F.lit(d).alias("disposition"), c.alias("code"), r.alias("reason"))
    return F.when(declared.isNull(), row("unavailable", F.lit(NO_CANDIDATE), absent)).when(code.isNull(), row("failed", F.lit(UNREAD), unread)).otherwise(row("unavailable", code, full))


def event_instant(value: Column) -> Column:
    """Microseconds of a stated instant (extended ISO 8601 with an offset), counted so that
    0001-01-01 is day 1; null stays null; no offset, digits finer than a microsecond or an
    impossible date refuse."""
    at = F.try_to_timestamp(F.translate(value, ",", "."))
    bad = F.raise_error(F.concat(F.lit("not an instant of microseconds with an offset: "), value)).cast("long")
    return F.when(value.isNull(), None).when(value.rlike(_INSTANT) & at.isNotNull(), F.unix_micros(at) + F.lit(_EPOCH)).otherwise(bad)


def own_facts(facts: Column, key: Column, id_field: str = "id") -> Column:
    """The facts of an array of structs whose id is the item's key; null for a null array."""
    return F.filter(facts, lambda f: f[id_field] == key)


def numbered_interpretations(rows: DataFrame, item: str, interpretations: str, kind: str) -> DataFrame:
    """A row an interpretation: item, kind, a four-digit number within the kind in the order
    given, and the interpretation.  No shuffle: an item's array is numbered where it lies."""
    own = F.col(interpretations)
    number = lambda x, i: F.size(F.filter(F.slice(own, 1, i), lambda y: y[kind] == x[kind]))
    numbered = F.transform(own, lambda x, i: F.struct(x[kind].alias("kind"), F.lpad(number(x, i).cast("string"), 4, "0").alias("number"), x.alias("value")))
    return rows.select(item, F.explode(numbered).alias("__n")).select(item, "__n.kind", "__n.number", "__n.value")


def matched(rows: DataFrame, key: str, field: str, wanted: str, facts: list[str]) -> DataFrame:
    """``key, matches, unavailable``: whether the field is exactly ``wanted`` (a null is not),
    and the names of the facts that are null, sorted."""
    unavailable = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(facts)]))
    return rows.select(key, F.coalesce(F.col(field) == wanted, F.lit(False)).alias("matches"), unavailable.alias("unavailable"))


def framed_digest(rows: DataFrame, payload: str, order: list[str], domain: str, name: str) -> DataFrame:
    """``records, digest``: SHA-256 of domain, NUL, framed name, count, then each payload in
    order behind its length (eight bytes, big-endian).  Serial by definition: payloads pass
    through one task as a sorted stream, and none is held; a null payload refuses."""
    refuse_any(rows.where(F.col(payload).isNull()), "a payload is null")
    count, own = rows.count(), name.encode()
    head = domain.encode() + b"\0" + struct.pack(">Q", len(own)) + own + struct.pack(">Q", count)
    schema = "records long, digest string"
    if not count:  # Spark runs no task over no rows
        return rows.sparkSession.createDataFrame([(0, "sha256:" + hashlib.sha256(head).hexdigest())], schema)

    def digest(batches):
        h, n = hashlib.sha256(head), 0
        for batch in batches:
            for value in batch.column("e"):
                raw = value.as_buffer()
                h.update(struct.pack(">Q", raw.size))
                h.update(raw)
                n += 1
        if n != count:
            raise ValueError(f"the section declares {count} records and holds {n}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array(["sha256:" + h.hexdigest()])], names=["records", "digest"])

    # One task sorts, spilling to disk: coalescing sorted ranges would not promise their order.
    sorted_ = rows.select(F.col(payload).cast("binary").alias("e"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sorted_ = sorted_.repartition(1).sortWithinPartitions(*[f"o{i}" for i in range(len(order))])
    return sorted_.select("e").mapInArrow(digest, schema)


def bounded_batches(batches, sized: list[str], *, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES):
    """Slices of Arrow batches, without a copy, of at most ``most_rows`` rows and
    ``most_bytes`` bytes in the columns ``sized``; a larger row refuses, a null has no bytes.
    To be called within ``mapInArrow``."""
    for batch in batches:
        sizes = sum((pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sized), np.zeros(batch.num_rows, np.int64))
        if len(sizes) and sizes.max() > most_bytes:
            raise LimitExceeded(f"a row holds {sizes.max()} bytes")
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at] - sizes[at]
            to = min(int(np.searchsorted(ends, before + most_bytes, "right")), at + most_rows)
            yield batch.slice(at, to - at)
            at = to

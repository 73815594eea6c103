import hashlib
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.errors import LimitExceeded, Refused
from sedimenta.operators import facts, selections


def test_instants_count_from_the_day_before_year_one(spark):
    rows = [("0001-01-01T00:00:00Z",), ("1970-01-01T00:00:00.000001+00:00",), ("2024-02-29T12:00:00,5000000-05:00",), (None,)]
    got = [r.i for r in spark.createDataFrame(rows, "t string").select(facts.event_instant(F.col("t")).alias("i")).collect()]
    leap = (738_945 * 86_400 + 17 * 3_600) * 1_000_000 + 500_000
    assert got == [86_400_000_000, 719_163 * 86_400_000_000 + 1, leap, None]


@pytest.mark.parametrize("stated", ["2024-01-01T00:00:00", "2024-01-01T00:00:00.0000001Z", "2024-13-01T00:00:00Z", "soon", ""])
def test_unusable_instants_refuse(spark, stated):
    with pytest.raises(Exception, match="not an instant"):
        spark.createDataFrame([(stated,)], "t string").select(facts.event_instant(F.col("t"))).collect()


def test_agencies_of_nothing_and_of_null_entries(spark):
    kind = "e array<struct<name:string,raw_name:string,slug:string,id:long>>"
    rows = [(None,), ([],), ([None, ("", "Raw", "", 7), ("N", None, None, -1)],), ([("b", None, "\U0001f600", 1), ("a", None, "￮", 1)],)]
    resolved, rest = facts.agencies(F.col("e"))
    got = spark.createDataFrame(rows, kind).select(resolved.alias("r"), F.size(F.coalesce(rest, F.expr("filter(e, x -> false)"), F.array())).alias("n")).collect()
    assert [[tuple(a) for a in r.r] for r in got] == [[], [], [("federal-register:7", "Raw")], [("\U0001f600", "b"), ("￮", "a")]]
    assert [r.n for r in got] == [0, 0, 2, 0]


def test_arrays_pass_and_other_values_are_rejected(spark):
    rows = [("[]",), ('[1, "a", null, {"b": 2}]',), ("null",), (None,), ("3",), ("[1",)]
    items, rejected = facts.array_or_rejected(F.col("v"))
    got = spark.createDataFrame(rows, "v string").select(items.alias("i"), rejected.alias("r")).collect()
    assert [r.i for r in got] == [[], ["1", '"a"', "null", '{"b":2}'], [], [], [], []]
    assert [r.r for r in got] == [[], [], [], [], ["3"], ["[1"]]


def test_framed_digest_of_empty_and_null_payloads(spark):
    rows = spark.createDataFrame([(2, "é"), (1, "")], "k int, v string")
    h = hashlib.sha256(b"d\0" + struct.pack(">Q", 1) + b"s" + struct.pack(">QQQ", 2, 0, 2) + "é".encode())
    assert facts.framed_digest(rows, "v", ["k"], "d", "s").first() == (2, "sha256:" + h.hexdigest())
    none = hashlib.sha256(b"d\0" + struct.pack(">Q", 1) + b"s" + struct.pack(">Q", 0))
    assert facts.framed_digest(rows.limit(0), "v", ["k"], "d", "s").first() == (0, "sha256:" + none.hexdigest())
    with pytest.raises(Refused):
        facts.framed_digest(rows.withColumn("v", F.lit(None).cast("string")), "v", ["k"], "d", "s")


def test_batches_are_cut_by_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"v": ["aa", None, "bbb", "c", "", "dddd"], "w": ["x"] * 6})
    cut = [b.column("v").to_pylist() for b in facts.bounded_batches([batch, batch.slice(0, 0)], ["v"], most_rows=3, most_bytes=5)]
    assert cut == [["aa", None, "bbb"], ["c", "", "dddd"]]
    assert [b.num_rows for b in facts.bounded_batches([batch], ["v", "w"], most_rows=2, most_bytes=8)] == [2, 2, 2]
    with pytest.raises(LimitExceeded):
        list(facts.bounded_batches([batch], ["v"], most_bytes=3))
    assert [b.num_rows for b in facts.bounded_batches([batch.slice(1, 1)], ["v"], most_bytes=0)] == [1]


def test_interpretations_are_numbered_within_their_kind(spark):
    kind = "k string, a array<struct<kind:string,v:int>>"
    rows = spark.createDataFrame([("x", [("t", 1), ("j", 2), ("t", 3)]), ("y", []), ("z", None)], kind)
    got = facts.numbered_interpretations(rows, "k", "a", "kind").select("k", "kind", "number", "value.v").collect()
    assert [tuple(r) for r in got] == [("x", "t", "0000", 1), ("x", "j", "0000", 2), ("x", "t", "0001", 3)]


def test_stream_digest_of_no_rows(spark):
    rows = spark.createDataFrame([], "k int, v string")
    assert selections.stream_digest(rows, "v", ["k"]).first() == (0, "sha256:" + hashlib.sha256(b"[]").hexdigest())

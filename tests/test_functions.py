import datetime as dt
import decimal
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.errors import Refused
from sedimenta.functions import json as J
from sedimenta.functions import rows as R
from sedimenta.functions import security, text

ODD = ["", " ", "a b\tc", "\x1ca\x1db\x1e", "a\u00a0b\u2003c\u3000", "one\r\ntwo\rthree\n", "x\n\n", "\x85x\u2028y", "no end", "\n", "tab\x0bfeed\x0c", "é😀 z"]


def one(spark, value, kind, expression):
    frame = spark.createDataFrame([(value,)], f"x {kind}")
    return frame.select(expression(F.col("x")).alias("y")).first().y


def test_words_lines_and_strip_follow_unicode_text_rules(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    got = frame.select("i", text.word_count("t").alias("w"), text.line_count("t").alias("l"), text.strip("t").alias("s")).orderBy("i").collect()
    assert [(r.w, r.l, r.s) for r in got] == [(len(t.split()), len(t.splitlines()), t.strip()) for t in ODD]


def test_statistics_of_bytes_that_are_not_text(spark):
    frame = spark.createDataFrame([(b"\xff\xfe",), (b"ab c\n",)], "x binary")
    got = [tuple(r) for r in frame.select(*text.content_statistics("x")).collect()]
    assert got == [("sha256:" + hashlib.sha256(b"\xff\xfe").hexdigest(), 2, None, None, None), ("sha256:" + hashlib.sha256(b"ab c\n").hexdigest(), 5, 5, 1, 2)]


def test_bucket_and_urn(spark):
    want = int.from_bytes(hashlib.sha256(b"key").digest()[:8], "big") % 64
    assert one(spark, "key", "string", lambda c: text.bucket(c, 64)) == want
    assert one(spark, "v", "string", lambda c: text.stable_urn("segment", c)).endswith(hashlib.sha256(b"v").hexdigest())


def test_utf16_order_differs_for_supplementary_characters(spark):
    frame = spark.createDataFrame([("\uffee",), ("😀",), ("a",)], "t string")
    assert [r.t for r in frame.orderBy(text.utf16_key("t")).collect()] == ["a", "😀", "\uffee"]


@pytest.mark.parametrize(("raw", "day"), [("2024-02-29T00", "2024-02-29"), ("2023-02-29", None), ("2024-1-01", None), ("soon", None), ("0000-01-01", None), (None, None), ("9999-12-31x", "9999-12-31")])
def test_dates(spark, raw, day):
    got = one(spark, raw, "string", text.date_value)
    assert got.value == day and got.unparseable == ([] if raw is None or day else [raw])


@pytest.mark.parametrize(("raw", "day"), [("2024-02-29T23:59:59Z", "2024-02-29"), ("2024-02-29T24:00:00Z", None), ("2024-02-29T01:02:03.5Z", None), ("2024-02-30T01:02:03Z", None), ("2024-02-29 01:02:03Z", None)])
def test_instants(spark, raw, day):
    assert one(spark, raw, "string", text.utc_instant_date).value == day


def test_other_normalisers(spark):
    assert one(spark, "ＲＩＮ", "string", text.rin) is None and one(spark, " 1234-ab12 ", "string", text.rin) == "1234-AB12"
    assert one(spark, "http://", "string", text.http_url) is None and one(spark, "HTTPS://x", "string", text.http_url) == "HTTPS://x"
    assert one(spark, "Text/HTML; charset=x", "string", text.media_type) == "text/html"
    assert one(spark, ["b", "", None, "a", "b"], "array<string>", text.string_set).asDict() == {"values": ["a", "b"], "unparseable": ["", None]}
    assert one(spark, "\u2003", "string", text.text_value).unparseable == ["\u2003"]
    topics = one(spark, [{"id": "", "name": "n"}, {"id": "i", "name": "n"}, {"id": "z", "name": None}], "array<struct<id:string,name:string>>", lambda c: text.observed_topics(c, "s", identity_fields=("id",), label_fields=("name",)))
    assert [(t.id, t.label) for t in topics] == [("i", "n"), ("n", "n")]
    with pytest.raises(Exception, match="reserved"):
        one(spark, ["urn:ref:x"], "array<string>", lambda c: text.observed_topics(c, "s"))


def test_canonical_json():
    assert J.canonical({"b": [1, None, True], "a": "\x1f\"\\\n/é😀", "\uffee": 1, "😀": 2}) == '{"a":"\\u001f\\"\\\\\\n/é😀","b":[1,null,true],"😀":2,"\uffee":1}'
    for bad in ("{\"a\":1,\"a\":2}", "NaN", "[1", "1 2"):
        with pytest.raises(Refused):
            J.closed(bad)
    for bad in (1.5, 2**53):
        with pytest.raises(Refused):
            J.canonical(bad)


def test_json_string_spelling_is_canonical(spark):
    for t in ["".join(map(chr, range(32))) + "\"\\/\x7fé😀", "plain", ""]:
        assert one(spark, t, "string", J.json_string) == J.canonical(t)


POINTERS = [
    (None, "", None), ({}, "/x", J.ABSENT), ({"x": None}, "/x", None), ({"x": False}, "/x", False), ({"a/b": {"~k": 7}}, "/a~1b/~0k", 7), ({"~1": 8}, "/~01", 8), ({"": 9}, "/", 9),
    ({"01": "p"}, "/01", "p"), (["a", "b"], "/1", "b"), (["a", "b"], "/01", J.ABSENT), (["a"], "/-", J.ABSENT), (["a"], "/-1", J.ABSENT), (["a"], "/99", J.ABSENT), (1, "/x", J.ABSENT),
]


@pytest.mark.parametrize(("value", "pointer", "want"), POINTERS)
def test_pointers(value, pointer, want):
    got = J.pointer_get(value, pointer)
    assert got is want if want is J.ABSENT else J.json_equal(got, want)


@pytest.mark.parametrize("pointer", ["x", "/x~2", "/x~"])
def test_bad_pointers_refuse(pointer):
    with pytest.raises(Refused):
        J.pointer_tokens(pointer)


def test_selection_keeps_absent_null_and_types_apart(spark):
    rows = [({"x": None},), ({"x": 1},), ({"x": "1"},), ({},), ({"x": [1]},)]
    frame = spark.createDataFrame([(json.dumps(r[0]),) for r in rows], "t string").select(F.parse_json("t").alias("v"))
    got = [(r.s.state, r.s.kind, r.s.value) for r in frame.select(J.selected("v", "/x").alias("s")).collect()]
    assert got == [("present", "VOID", "null"), ("present", "BIGINT", "1"), ("present", "STRING", '"1"'), ("absent", None, None), ("present", "ARRAY<BIGINT>", "[1]")]
    fields = json.dumps([["a", "/x"], ["b", "/x/0"]])
    out = spark.createDataFrame([('{"x":[5]}', fields), (None, fields)], "v string, f string").select(J.select_fields_udf("v", "f").alias("o")).collect()
    assert [r.o for r in out] == ['[["a","present",[5]],["b","present",5]]', '[["a","absent"],["b","absent"]]']


def test_patches(spark):
    value = {"a": [1, 2], "b": {"c": 3}}
    ops = [{"op": "test", "path": "/a/0", "value": 1}, {"op": "add", "path": "/a/-", "value": 9}, {"op": "add", "path": "/a/0", "value": 0}, {"op": "move", "from": "/b/c", "path": "/d"}, {"op": "copy", "from": "/a", "path": "/e"}, {"op": "remove", "path": "/a/1"}, {"op": "replace", "path": "/b", "value": None}]
    want = {"a": [0, 2, 9], "b": None, "d": 3, "e": [0, 1, 2, 9]}
    assert J.apply_patch(value, ops) == want and value == {"a": [1, 2], "b": {"c": 3}}
    for bad in ([{"op": "test", "path": "/a/0", "value": True}], [{"op": "remove", "path": ""}], [{"op": "replace", "path": "/q", "value": 1}], [{"op": "add", "path": "/q/r", "value": 1}], [{"op": "move", "from": "/b", "path": "/b/c"}], [{"op": "add", "path": "/x"}], [{"op": "odd", "path": "/x"}]):
        with pytest.raises(Refused):
            J.apply_patch(value, bad)
    frame = spark.createDataFrame([('{"a":1}', '[{"op":"add","path":"/b","value":"é"}]')], "v string, o string")
    assert frame.select(J.patch_udf("v", "o").alias("p")).first().p == '{"a":1,"b":"é"}'


def test_differences(spark):
    assert J.json_changes({"a": 1, "b": {"c": 1}}, {"a": True, "b": {}, "d/~": None}) == [("/a", "changed", "1", "true"), ("/b/c", "removed", "1", None), ("/d~1~0", "added", None, "null")]
    assert not J.json_equal(1, True) and J.json_equal({"a": [1]}, {"a": [1]})
    frame = spark.createDataFrame([('{"a":1}', '{"a":2}'), (None, "1")], "a string, b string")
    assert [len(r.c) for r in frame.select(J.changes_udf("a", "b").alias("c")).collect()] == [1, 1]


def test_member_text(spark):
    frame = spark.createDataFrame([("1", "k\"", "e"), (None, "k", "e")], "v string, k string, e string")
    got = frame.select(J.member_text(F.col("v"), F.col("k"), F.col("e")).alias("m")).collect()
    assert [r.m for r in got] == ['["present",1,["key","k\\""],["entity","e"]]', '["absent",["key","k"],["entity","e"]]']


SCHEMA = "number string, `text\x1f` string, flag boolean, count int, big long, ratio double, day date, moment timestamp_ntz, zoned timestamp, items array<string>, price decimal(10,2), s struct<b:int,a:string>"


def test_row_spelling(spark):
    utc = dt.timezone.utc
    rows = [
        ("2026-\x1f\"1\\", "control \x00\n \"q\" \\u001F", True, -(2**31), -(2**63), float("nan"), dt.date(1, 1, 1), dt.datetime(2024, 5, 6, 7, 8, 9), dt.datetime(2026, 9, 25, 1, 2, 3, 123400, tzinfo=dt.timezone(dt.timedelta(hours=5, minutes=30))), ["\x00", None, "😀"], decimal.Decimal("-0.00"), (1, None)),
        ("k", "é", False, 2**31 - 1, 2**53, -0.0, dt.date(9999, 12, 31), dt.datetime(2026, 9, 25, 1, 2, 3, 1), dt.datetime(2026, 9, 25, tzinfo=utc), [], decimal.Decimal("12.50"), None),
        (" ", "", None, 0, 2**53 - 1, 1e21, None, None, None, None, None, None),
        ("a", "b", None, None, None, 5e-324, None, None, None, None, None, None),
        ("a", "b", None, None, None, float("-inf"), None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)

    def spell(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, int):
            return str(v) if abs(v) > J.SAFE_INTEGER else v
        if isinstance(v, float):
            return "nan" if v != v else repr(v)
        if isinstance(v, dt.datetime):
            return v.astimezone(utc).isoformat().replace("+00:00", "Z") if v.tzinfo else v.isoformat() + "Z"
        if isinstance(v, dt.date):
            return v.isoformat()
        if isinstance(v, decimal.Decimal):
            return f"{abs(v) if v == 0 else v:.2f}"
        if isinstance(v, list):
            return [spell(x) for x in v]
        return {"b": spell(v[0]), "a": spell(v[1])} if isinstance(v, tuple) else v

    names = frame.columns
    want = [J.canonical({n: spell(v) for n, v in zip(names, r, strict=True)}) for r in rows]
    assert [r.j for r in frame.select(R.row_json(frame.schema).alias("j")).collect()] == want
    with pytest.raises(Refused):
        R.row_json(T.StructType([T.StructField("a", T.FloatType())]))
    with pytest.raises(Refused):
        R.row_json(T.StructType([T.StructField("a", T.LongType()), T.StructField("A", T.LongType())]))


def test_member_keys(spark):
    frame = spark.createDataFrame([("x@y", dt.date(1, 1, 1), 7, "a"), ("b", None, 1, None), ("", dt.date(2024, 2, 29), 2, "c#1")], "n string, d date, i int, o string")
    good = frame.where("i = 7")
    assert good.select(R.key_number_date(frame.schema, "n", "d").alias("k")).first().k == "x@y@0001-01-01"
    assert [r.k for r in frame.select(R.key_tuple(frame.schema, ["n", "d", "o"]).alias("k")).collect()] == ['["x@y","0001-01-01","a"]', '["b",null,null]', '["","2024-02-29","c#1"]']
    for expression in (R.key_at_joined(frame.schema, ["n", "i"]), R.key_value(frame.schema, "o"), R.key_number_date(frame.schema, "n", "d")):
        with pytest.raises(Exception, match="key"):
            frame.select(expression).collect()
    with pytest.raises(Refused):
        R.key_at_joined(frame.schema, ["n"])
    s = frame.select(R.split_segment_key(F.lit("a#b#-12")).alias("s")).first().s
    assert (s.member, s["index"]) == ("a#b", -12)
    assert set(R.at_splits("a@b@c", 2)) == {("a", "b@c"), ("a@b", "c")}


def test_rows_differ_by_sign_of_zero_and_not_by_nan(spark):
    a = spark.createDataFrame([(1, 0.0, [1.0]), (2, float("nan"), None), (3, 1.0, [1.0]), (4, None, None)], "k int, x double, y array<double>")
    b = spark.createDataFrame([(1, -0.0, [1.0]), (2, float("nan"), None), (3, 1.0, [1.0, 2.0]), (4, None, None)], "k int, x double, y array<double>")
    joined = a.alias("l").join(b.alias("r"), F.col("l.k") == F.col("r.k"))
    assert {r.k for r in joined.where(R.differ(a.schema, "l", "r", ["x", "y"])).select("l.k").collect()} == {1, 3}
    lists = spark.createDataFrame([([1.0, None, float("nan"), -0.0],), (None,)], "y array<double>")
    assert [r.j for r in lists.select(R.row_json(lists.schema).alias("j")).collect()] == ['{"y":["1.0",null,"nan","-0.0"]}', '{"y":null}']
    assert R.volatile_columns(["fetched_at", "x_OBSERVED_AT", "observed_at_x", "prefetched_at"]) == ["fetched_at", "x_OBSERVED_AT"]


SECRETS = {
    "openai-key": "sk-proj-" + "a1" * 12, "github-token": "ghp_" + "A1" * 12, "stripe-key": "sk_live_" + "a" * 16, "google-api-key": "AIza" + "b" * 32, "aws-access-key": "ASIA" + "A1" * 8,
    "aws-secret-access-key": "AWS_secret_access_key: " + "a" * 40 + " ", "bearer-token": "bearer " + "x" * 20, "jwt": "eyJabcdef.abcdef.abcdef", "private-key": "-----BEGIN EC PRIVATE KEY-----",
    "credential-url": "ftp://u:p@h", "credential-assignment": "Client-Secret = longenough",
}


def test_secret_rules(spark):
    texts = [*SECRETS.values(), "nothing", "AKIA123", "sk-short", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [list(r.m) if r.m is not None else None for r in frame.select(security.secret_markers("t").alias("m")).collect()]
    for name, t, m in zip(SECRETS, texts, got, strict=False):
        assert name in m and m == security.markers(t)
    assert got[len(SECRETS) : -1] == [[], [], []]
    assert one(spark, texts[0], "string", security.redact_text) == security.REDACTED
    value = {"Api-Key": 1, "ok": ["x", SECRETS["jwt"]], SECRETS["github-token"]: {"n": 1}}
    assert security.secret_paths(value) == sorted(["$.Api-Key", "$.ok[1]", f"$.{SECRETS['github-token']}"])
    assert security.redact(value) == {"Api-Key": security.REDACTED, "ok": ["x", security.REDACTED], security.REDACTED: {"n": 1}}


def test_utf16_order_ranks_whole_texts(spark, tmp_path):
    from sedimenta.plans.queries import queries

    shared = "the same opening "
    texts = [shared + t for t in ("b", "a", "😀", "￮", "", "ab", "a\u0000")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["utf16_order"](spark, str(tmp_path)).orderBy("sort_key").collect()
    assert [r.doc_id for r in rows] == sorted(range(len(texts)), key=lambda i: texts[i].encode("utf-16-be"))


def test_a_patch_may_remove_the_whole_value_and_add_another():
    from sedimenta.functions.json import apply_patch

    assert apply_patch({"a": 1}, [{"op": "remove", "path": ""}, {"op": "add", "path": "", "value": [2]}]) == [2]
    for operations in ([{"op": "remove", "path": ""}], [{"op": "remove", "path": ""}, {"op": "remove", "path": ""}], [{"op": "remove", "path": ""}, {"op": "replace", "path": "", "value": 1}], [{"op": "remove", "path": ""}, {"op": "add", "path": "/a", "value": 1}]):
        with pytest.raises(Refused):
            apply_patch({"a": 1}, operations)


def test_redaction_of_nested_values():
    key = "sk-" + "a" * 24
    value = {"a": [{"password": {"x": 1}}, key, "plain"], key: 1, "Api-Key": ["v"], "n": {"m": (1, key)}}
    assert security.secret_paths(value) == sorted(["$.a[0].password", "$.a[1]", f"$.{key}", "$.Api-Key", "$.n.m[1]"])
    gone = security.REDACTED
    assert security.redact(value) == {"a": [{"password": gone}, gone, "plain"], gone: 1, "Api-Key": gone, "n": {"m": [1, gone]}}
    assert security.redact(key) == gone and security.redact({}) == {} and security.secret_paths([]) == []

import random

import pytest
from pyspark.sql import functions as F

from sedimenta.errors import LimitExceeded, Refused, StaleBase
from sedimenta.functions import rows as R
from sedimenta.operators import catalog, census, closure, guards, selections, states, tables
from sedimenta.plans.workspace import Workspace, open_export
from sedimenta.sources import generations, records
from sedimenta.sources.layers import LayerStore

KV = "member_key string, value string"
MEMBERS = "member_key string, occurrence_id string"
EDITS = "member_key string, sequence long, action string, occurrence_id string"


def kv(spark, **rows):
    return spark.createDataFrame(list(rows.items()), KV)


def as_dict(rows):
    return {r.member_key: r.occurrence_id for r in rows.collect()}


def eager(base, edits):
    """The plain reading of ordered edits; None where a remove hits nothing."""
    state = dict(base)
    for key, _, action, occurrence in sorted(edits, key=lambda e: e[1]):
        if action == "remove":
            if key not in state:
                return None
            del state[key]
        else:
            state[key] = occurrence
    return state


def test_edits_resolve_as_an_eager_reading_does(spark):
    r = random.Random(3)
    for _ in range(6):
        base = {k: f"b{k}" for k in "abcd" if r.random() < 0.6}
        edits = [(r.choice("abcde"), i, r.choice(["put", "put", "remove"]), f"o{i}") for i in range(r.randrange(0, 9))]
        frame, old = spark.createDataFrame(edits, EDITS), spark.createDataFrame(list(base.items()), MEMBERS)
        want = eager(base, edits)
        if want is None:
            with pytest.raises(Refused):
                states.resolve_edits(old, frame)
        else:
            assert as_dict(states.resolve_edits(old, frame)) == want


def test_invalid_edits_are_seen_before_reduction(spark):
    base = spark.createDataFrame([("a", "x")], MEMBERS)
    bad = spark.createDataFrame([("a", 1, "remove", None), ("a", 2, "remove", None), ("a", 3, "put", "y")], EDITS)
    with pytest.raises(Refused):
        states.resolve_edits(base, bad)
    puts = spark.createDataFrame([("a", 1, "put", "new"), ("b", 2, "put", "x")], EDITS)
    assert [r.occurrence_id for r in states.unavailable_puts(puts, base).collect()] == ["new"]


def test_compare_counts_occurrences_and_values_for_the_sample(spark):
    old_m, old_e = states.create(kv(spark, a="1", b="2", c="3"), "one")
    new_m, new_e = states.create(kv(spark, a="1", b="9", d="4"), "two")
    counts, sample = states.compare(old_m, new_m, old_e, new_e, sample=3)
    assert {r.change: r.n for r in counts.collect()} == {"changed": 2, "removed": 1, "added": 1}
    assert [(r.member_key, r.change, r.value_changed) for r in sample.collect()] == [("a", "changed", False), ("b", "changed", True), ("c", "removed", True)]
    assert {(r.member_key, r.value) for r in states.changes(old_m, new_m, new_e).collect()} == {("a", "1"), ("b", "9"), ("c", None), ("d", "4")}
    assert not states.same_membership(old_m, new_m) and states.same_membership(old_m, states.create(kv(spark, a="1", b="2", c="3"), "one")[0])
    with pytest.raises(LimitExceeded):
        states.compare(old_m, new_m, old_e, new_e, sample=9999)
    with pytest.raises(Refused):
        states.create(spark.createDataFrame([("a", "1"), ("a", "2")], KV), "x")


def test_reading_helpers(spark):
    m = spark.createDataFrame([("a", "1"), ("", "2")], MEMBERS)
    e = spark.createDataFrame([("1", "v")], "occurrence_id string, value string")
    wanted = spark.createDataFrame([("a",), ("z",), ("a",)], "member_key string")
    assert as_dict(states.named_scope(m, wanted)) == {"a": "1", "z": None}
    assert [r.member_key for r in states.incomplete_members(m, e).collect()] == [""]
    other = spark.createDataFrame([("1", "w")], "occurrence_id string, value string")
    assert states.conflicting_values(e, other).count() == 1 and states.conflicting_values(e, e).count() == 0
    with pytest.raises(Refused):
        states.find_members(m, [e, other])
    ordered = states.positions(spark.range(100).select(((F.col("id") * 37) % 100).alias("k")), F.col("k")).collect()
    assert {r.k: r.position for r in ordered} == {i: i for i in range(100)}
    frame = spark.createDataFrame([(i,) for i in range(600)], "k int")
    assert guards.where_in(frame, "k", [1, 5]).count() == 2 and guards.where_in(frame, "k", list(range(300, 900))).count() == 300


def test_table_generations(spark):
    columns = ("k", "v", "w")
    old = spark.createDataFrame([(1, "a", 0.0), (2, "b", 1.0), (3, "c", 2.0)], "k long, v string, w double")
    new = spark.createDataFrame([(1, "a", -0.0), (2, "b", 1.0), (4, "d", None)], "k long, v string, w double")
    identity = tables.TableIdentity("f", "t", R.key_value(old.schema, "k"), columns)
    a, b = tables.checked_identities(old, identity), tables.checked_identities(new, identity)
    index = tables.append_occurrences(a.limit(0), a, "s1")
    counts = tables.delta_counts(b, a, index, list(columns)).first().asDict()
    assert counts == {"carried": 1, "added": 1, "changed": 1, "removed": 1, "generated": 2, "adopted": 0}
    merged = tables.advance_membership(a.select("member_key", "occurrence_hash"), b)
    assert tables.membership_audit(b, merged).count() == 0 and merged.count() == 3
    found = tables.lookup_occurrences(index, identity, a.where("k = 2"))
    assert [r.member_key for r in found.collect()] == ["2"]
    with pytest.raises(Refused):
        tables.lookup_occurrences(index.withColumn("member_key", F.lit("9")), identity, a)
    with pytest.raises(Refused):
        tables.TableIdentity("f", "t", R.key_value(old.schema, "k"), ("k", "fetched_at")).identify(old.withColumn("fetched_at", F.lit("x")))
    keyed = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1")], "x string, y string")
    assert tables.key_pruned(keyed, ["x", "y"], ["a@1"]).count() == 1
    assert tables.set_digest(a, "occurrence_hash").first() == tables.set_digest(a.unionByName(a), "occurrence_hash").first()


def test_incremental_derivation_and_lineage(spark):
    schema = "member_key string, segment_index int, occurrence_hash string, sources array<string>"
    base = spark.createDataFrame([("a", 0, "h1", ["x"]), ("a", 1, "h2", ["x", "y"]), ("b", 0, "h3", ["z"]), ("c", 0, "h4", ["q"])], schema)
    staged = spark.createDataFrame([("a", 0, "h1", ["x"]), ("a", 2, "h9", ["y"])], schema)
    gone = spark.createDataFrame([("c",)], "member_key string")
    rows, counts = tables.derive_incremental(base, staged, gone, ["member_key", "segment_index"])
    assert {(r.member_key, r.segment_index) for r in rows.collect()} == {("a", 0), ("a", 2), ("b", 0)}
    assert counts.first().asDict() == {"written": 1, "replaced": 0, "removed": 2, "unchanged": 1}
    with pytest.raises(Refused):
        tables.derive_incremental(base, staged, spark.createDataFrame([("a",)], "member_key string"), ["member_key", "segment_index"])
    changed = spark.createDataFrame([("z",), ("none",)], "occurrence_id string")
    assert [r.member_key for r in tables.affected_rows(base, changed).collect()] == ["b"]


def test_selections(spark):
    a = spark.createDataFrame([("k1", "x"), ("k2", "x"), ("k3", "y")], "member_key string, encoded string")
    b = spark.createDataFrame([("k1", "y"), ("k2", "x"), ("k9", "x")], "member_key string, encoded string")
    assert selections.same_multiset(a, b) and not selections.same_multiset(a, b.limit(2))
    one = selections.stream_digest(a, "encoded", ["encoded", "member_key"]).first()
    two = selections.stream_digest(b, "encoded", ["encoded", "member_key"]).first()
    assert one == two and one.members == 3
    frame = spark.createDataFrame([("k", '{"x":null}')], KV)
    got = selections.extract(frame, "value", [("f", "/x"), ("g", "/y")]).select(selections.labelled(["f", "g"]).alias("l")).first().l
    assert got == '[["f","present",null],["g","absent"]]'


def test_catalog_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, k string")
    assert catalog.index_counts(rows, F.col("k")).first().asDict() == {"indexed": 1, "ambiguous": 2, "unkeyed": 1}
    joined = catalog.exact_join(rows, F.col("k"), catalog.unique_index(rows, F.col("k")), "j")
    assert {r.id: r.j.outcome for r in joined.collect()} == {1: "no-match", 2: "no-match", 3: "matched", 4: "not-stated"}
    coverage = catalog.join_coverage(joined.select("j.join", "j.outcome"))
    assert coverage.first().asDict() == {"join": "j", "eligible": 3, "matched": 1, "unmatched": 2, "null_result": 1}
    with pytest.raises(Refused):
        catalog.refuse_collapsed(coverage.withColumn("matched", F.lit(0)), least=3)
    filings = spark.createDataFrame([("EPA-1-2", "EPA-1", "EPA"), ("EPA-1-2", "DOT-1", "DOT"), ("x", "y", "z")], "item string, docket string, agency string")
    assert {(r.item, r.docket, r.other_filings) for r in catalog.owned_records(filings, "item", "docket", "agency").collect()} == {("EPA-1-2", "EPA-1", 1), ("x", "y", 0)}
    with pytest.raises(Refused):
        catalog.owned_records(filings.withColumn("docket", F.lit("q")), "item", "docket", "agency")
    decided = catalog.decide(rows, [("has key", F.col("k").isNotNull(), "failed", "no-key"), ("odd", F.col("id") % 2 == 1, "excluded", "even")])
    assert {r.id: (r.disposition, r.reason_code, len(r.decisions)) for r in decided.collect()} == {1: ("selected", None, 2), 2: ("excluded", "even", 2), 3: ("selected", None, 2), 4: ("failed", "no-key", 1)}
    catalog.reconcile(decided, spark.createDataFrame([("selected", 2), ("excluded", 1), ("failed", 1)], "disposition string, n long"))
    with pytest.raises(Refused):
        catalog.reconcile(decided, spark.createDataFrame([("selected", 4)], "disposition string, n long"))
    kept = catalog.apply_budget(decided, F.col("disposition") == "selected", F.col("id"), 1)
    assert {r.id for r in kept.where("in_budget").collect()} == {1}
    renditions = spark.createDataFrame([(1, "html", "b"), (1, "html", "a"), (1, "html", "a"), (1, "pdf", ""), (2, "odd", "z")], "item int, family string, locator string")
    assert [(r.item, r.family, r.locators) for r in catalog.prefer_rendition(renditions, "item", "family", "locator", ["pdf", "html"]).collect()] == [(1, "html", ["a", "b"])]
    sample = catalog.bounded_sample(rows, ["id"], most_rows=2, most_bytes=60)
    assert [x["id"] for x in sample] == [1, 2]


def test_samples_repeat_and_respect_limits(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("p"), (F.col("id") % 7).alias("g"))
    s = catalog.stratified_sample(rows, item="id", partition="p", strata=[F.col("g")], seed="1", limit=10)
    again = catalog.stratified_sample(rows.repartition(5), item="id", partition="p", strata=[F.col("g")], seed="1", limit=10)
    assert {r.id for r in s.collect()} == {r.id for r in again.collect()} and s.count() == 30
    q = catalog.salted_sample(rows, item="id", within="p", group="g", salt="s", total=21).groupBy("p").count().collect()
    assert all(r["count"] == 21 for r in q)


def test_census(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "abc"), (1, " "), (1, None), (2, "x")], "g int, t string")
    got = {r.g: r for r in census.text_coverage(rows, ["g"], "t").collect()}
    assert (got[1].rows, got[1].null_rows, got[1].blank_rows, got[1].present_rows, got[1].p50, got[1].p99) == (4, 1, 1, 2, 1, 3)
    low, high = spark.range(1).select(*census.wilson(F.lit(5.0), F.lit(10.0))).first()
    assert round(low, 4) == 0.2366 and round(high, 4) == 0.7634
    widths = spark.range(100).select("id", F.lit(10).alias("w"))
    assert census.row_group_rows(widths, "id", "w", 250) == 25
    fields = census.field_census(spark.createDataFrame([('{"a":1}',), ('{"a":null}',), ("{}",), ('{"a":"é"}',)], "j string"), "j", {"a": "/a"}).first()
    assert (fields.present, fields.non_null, fields.non_empty, fields.non_ascii, fields.kinds) == (3, 2, 2, 1, {"BIGINT": 1, "STRING": 1, "VOID": 1})


def test_closures(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "source string, target string")
    seeds = spark.createDataFrame([("b",)], "node string")
    assert {(r.node, r.depth) for r in closure.reachable(links, seeds).collect()} == {("b", 0), ("c", 1), ("a", 2)}
    assert {r.node for r in closure.both_ways(links, seeds).collect()} == {"a", "b", "c", "x"}
    with pytest.raises(Refused):
        closure.refuse_cycles(links)
    closure.refuse_cycles(links.where("source <> 'c'"))
    assert closure.operation_order({"c": ["a"], "b": [], "a": ["b"]}) == ["b", "a", "c"]
    for bad in ({"a": ["z"]}, {"a": ["b"], "b": ["a"]}):
        with pytest.raises(Refused):
            closure.operation_order(bad)
    made = spark.createDataFrame([("e1", "p", 1), ("e2", "q", 2)], "entity string, activity string, at int")
    used = spark.createDataFrame([("e1", 2)], "entity string, at int")
    derived = spark.createDataFrame([("e2", "e1")], "entity string, source string")
    closure.check_provenance(made, used, derived)
    for args in ((made.unionByName(spark.createDataFrame([("e1", "z", 1)], made.schema)), used, derived), (made, used.withColumn("at", F.lit(0)), derived), (made.withColumn("at", F.lit(2)), used, derived)):
        with pytest.raises(Refused):
            closure.check_provenance(*args)


def test_layers(spark, tmp_path):
    store = LayerStore(spark, f"file://{tmp_path}/w")
    base = store.write(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int"), kind="t", key=["k"])
    delta = store.apply(base, spark.createDataFrame([("b", 9), ("d", 4)], "k string, v int"), spark.createDataFrame([("c",)], "k string"))
    back = store.apply(delta, spark.createDataFrame([("c", 5)], "k string, v int"))
    read = lambda l: {r.k: r.v for r in store.relation(l).collect()}
    assert read(base) == {"a": 1, "b": 2, "c": 3} and read(delta) == {"a": 1, "b": 9, "d": 4} and read(back) == {"a": 1, "b": 9, "d": 4, "c": 5}
    assert read(store.compact(back)) == read(back) and read(store.open(back.id)) == read(back)
    more = store.append(back, spark.createDataFrame([("a", 7), ("z", 8)], "k string, v int"), exclude_existing=True)
    assert read(more)["a"] == 1 and read(more)["z"] == 8 and store.lookup(more, ["z"]).count() == 1 and store.scan_files(base).where("file like 'file:%'").count() == 3
    for call in (
        lambda: store.append(back, spark.createDataFrame([("a", 7)], "k string, v int")), lambda: store.apply(base, spark.createDataFrame([("a", 7), ("a", 8)], "k string, v int")),
        lambda: store.apply(base, spark.createDataFrame([("a", "7")], "k string, v string")), lambda: store.write(spark.createDataFrame([(None, 1)], "k string, v int"), kind="t", key=["k"]), lambda: store.open("0" * 64),
    ):
        with pytest.raises(Refused):
            call()
    encoded = store.write_encoded(spark.createDataFrame([(str(i), f"p{i % 5}", "{}") for i in range(20)], "record_identity string, partition_value string, record_json string"), kind="e", buckets=4)
    assert store.invalid_rows(encoded, 4).count() == 0 and store.invalid_rows(encoded, 5).count() > 0
    assert sum(store.relation(encoded, buckets=[b]).count() for b in range(4)) == 20 and store.relation(encoded, ranges=[("0", "1")]).count() == 2
    path = f"{tmp_path}/outside"
    spark.createDataFrame([("q", 1)], "k string, v int").write.parquet(path)
    assert read(store.register([f"file://{path}"], kind="t", schema=base.schema, key=["k"])) == {"q": 1}


def test_workspace(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    first = w.create(kv(spark, a='{"n":1}', b="2"), "b1")
    assert w.create(kv(spark, a='{"n":1}', b="2"), "b1") == first
    with pytest.raises(Refused):
        w.create(kv(spark, a="other"), "b1")
    w.select_current("d", first, None)
    second = w.upsert(first, kv(spark, b="3", c="4"), "b2", dataset="d")
    assert w.upsert(first, kv(spark, b="3", c="4"), "b2", dataset="d") == second and w.current("d") == second
    with pytest.raises(Refused):
        w.upsert(first, kv(spark, q="1"), "b3", dataset="d")
    with pytest.raises(StaleBase):
        w.select_current("d", first, first)
    with pytest.raises(Refused):
        w.upsert(second, kv(spark, a="1").limit(0), "b4")
    third = w.upsert(second, kv(spark, d="5"), "b5", removals=spark.createDataFrame([("b",)], "member_key string"))
    read = lambda s: {r.member_key: r.value for r in w.rows(s).collect()}
    assert read(third) == {"a": '{"n":1}', "c": "4", "d": "5"} and w.certified_keys(first, third).distinct().count() == 3
    counts, sample = w.compare(first, third)
    assert {r.change: r.n for r in counts.collect()} == {"added": 2, "removed": 1} and sample.count() == 3
    assert {(r.member_key, r.value) for r in w.changes(first, third).collect()} == {("b", None), ("c", "4"), ("d", "5")}
    edited = w.edit_values(third, spark.createDataFrame([("a", '[{"op":"replace","path":"/n","value":7}]')], "member_key string, operations string"), "b6")
    assert read(edited)["a"] == '{"n":7}'
    old = as_dict(w.members(first))
    revised = w.revise(edited, spark.createDataFrame([("c", 1, "remove", None), ("z", 2, "put", old["b"])], EDITS), "b7")
    assert read(revised) == {"a": '{"n":7}', "d": "5", "z": "2"}
    packed = w.checkpoint(revised)
    assert read(packed) == read(revised) and w.inspect(packed)["parts"] == [1, 1]
    assert states.same_membership(w.members(packed), w.members(revised))
    assert as_dict(w.rows(packed, spark.createDataFrame([("nope",)], "member_key string"))) == {"nope": None}
    grouped = w.from_occurrences(first, spark.createDataFrame([("n", old["a"])], MEMBERS), "b8")
    assert read(grouped) == {"n": '{"n":1}'}
    pin = w.export(packed, f"file://{tmp_path}/x")
    assert open_export(spark, f"file://{tmp_path}/x", expected_pin=pin).count() == 3
    with pytest.raises(Refused):
        open_export(spark, f"file://{tmp_path}/x", expected_pin="0")
    assert w.remove_unreferenced([packed, third]) and read(packed) == read(w.open(packed.id)) and read(third)["d"] == "5"


def test_stream_ingestion_is_idempotent(spark, tmp_path):
    from sedimenta.streaming.ingest import upsert_stream

    w, source = Workspace(spark, f"file://{tmp_path}/w"), f"{tmp_path}/in"
    schema = "member_key string, value string, n long"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        q = upsert_stream(w, spark.readStream.schema(schema).json(source), dataset="d", name="s", checkpoint=f"{tmp_path}/ck", order="n")
        q.awaitTermination(120)
        return {r.member_key: r.value for r in w.rows(w.current("d")).collect()}

    assert feed([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)]) == {"a": "2", "b": "1"}
    assert feed([("b", "9", 3)]) == {"a": "2", "b": "9"}
    assert feed([("b", "9", 3)])["b"] == "9"


def test_generations(spark, tmp_path):
    import json
    import os

    root = f"{tmp_path}/gen"
    schema = "k long, day string"
    for day, ks in (("x", [1, 2]), ("y", [3])):
        spark.createDataFrame([(k, day) for k in ks], schema).coalesce(1).write.parquet(f"{root}/t/day={day}/part-000000.parquet")
    members = [{"key": "t/day=x/part-000000.parquet", "rows": 2}, {"key": "t/day=y/part-000000.parquet", "rows": 1}]
    body = {"family": "f", "tables": {"t": {"columns": {"k": "bigint", "day": "string"}, "rows": 3, "members": members, "partition": "day"}}}

    def publish(b):
        with open(f"{root}/g.json", "w") as f:
            json.dump(b, f)
        with open(f"{root}/current.json", "w") as f:
            json.dump({"generation": "g.json"}, f)
        for n in (".g.json.crc", ".current.json.crc"):
            if os.path.exists(f"{root}/{n}"):
                os.remove(f"{root}/{n}")
        return generations.resolve(spark, f"file://{root}", "f")

    g = publish(body)
    assert generations.table(spark, g, "t").count() == 3
    members[0]["rows"] = 5
    for bad in (lambda: generations.resolve(spark, f"file://{root}", "other"), lambda: generations.resolve(spark, f"file://{root}", "f", expected_pin="0"), lambda: generations.check_table(spark, publish(body), "t")):
        with pytest.raises(Refused):
            bad()
    generations.check_types(generations.table(spark, g, "t"), {"k": "bigint"})
    with pytest.raises(Refused):
        generations.check_types(generations.table(spark, g, "t"), {"k": "int"})
    subjects = spark.createDataFrame([("d1", "v1"), ("d2", "v1")], "d string, v string")
    receipts = spark.createDataFrame([("d1", "v1", True), ("d2", "v1", True), ("d3", "v", False)], "d string, v string, accepted boolean")
    generations.check_receipts(subjects, receipts, ["d", "v"])
    with pytest.raises(Refused):
        generations.check_receipts(subjects.limit(1), receipts, ["d", "v"])
    import glob

    feet = generations.footers(glob.glob(f"{root}/t/day=x/part-000000.parquet/*.parquet"))
    assert feet[0]["rows"] == 2 and feet[0]["statistics"]["k"]["max"] == 2


def test_records(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"key":"a","value":{"b":1,"a":null}}\n{"key":"","value":2}\n')
    rows = {r.member_key: r.value for r in records.keyed_json_lines(spark, f"file://{path}").collect()}
    assert rows == {"a": '{"a":null,"b":1}', "": "2"}
    for bad in ('{"key":1}\n', "oops\n"):
        path.write_text(bad)
        with pytest.raises(Refused):
            records.keyed_json_lines(spark, f"file://{path}").collect()
    contents = records.content_table(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string"), "c")
    assert contents.count() == 2 and records.broken_content(contents).count() == 0 and records.broken_content(contents.withColumn("size", F.lit(9))).count() == 2
    assert records.captured_files(spark, f"file://{path}").first()["size"] == 5
    got = records.fetch(spark.createDataFrame([("x://1",), ("y://1",)], "locator string"), {"x": lambda l, n: b"data"}).collect()
    assert [(bytes(r.content) if r.content else None, r.problem) for r in got] == [(b"data", None), (None, "no fetcher for y")]


def test_one_of_many_writers_creates_a_file(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from sedimenta.sources.control import Files

    files = Files(spark, f"file://{tmp_path}")
    for name in ("a", "b/c", "d"):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda i, name=name: files.create(name, {"by": i}), range(8)))
        assert sum(won) == 1 and files.read(name) == {"by": won.index(True)}
    assert files.names("") == ["a", "b", "d"] and files.names("b") == ["c"]


def test_large_rows_before_the_sample_lose_no_others(spark):
    from sedimenta.operators.catalog import bounded_sample

    rows = spark.createDataFrame([(i, "x" * (1000 if i < 50 else 1)) for i in range(60)], "i long, t string")
    assert [r["i"] for r in bounded_sample(rows, ["i"], most_rows=3, most_bytes=100)] == [50, 51, 52]
    assert bounded_sample(rows, ["i"], most_rows=0, most_bytes=100) == []

import pytest
from pyspark.sql import functions as F

from sedimenta import cli
from sedimenta.errors import LimitExceeded, Refused, StaleBase
from sedimenta.functions import segments
from sedimenta.operators import catalog, documents
from sedimenta.plans import catalogs, operations, pipeline
from sedimenta.sources.control import Files
from sedimenta.sources.layers import LayerStore

FILED = "document_id string, title string, posted_date string, agency_id string, docket_id string, register_number string, document_type string, withdrawn boolean, restrict_reason string"


def filings(spark):
    day = "2024-05-06T07:08:09Z"
    rows = [
        ("EPA-1-1", "One", day, "EPA", "EPA-1", "r1", "Rule", False, None), ("EPA-1-2", "Two", day, "EPA", "EPA-1", None, "Rule", True, None), ("EPA-1-3", " ", day, "EPA", "EPA-9", "r9", "Rule", False, None),
        ("EPA-1-4", "Four", day, "EPA", "EPA-1", "r2", "Rule", None, "copyrighted"), ("EPA-1-5", "Five", day, "EPA", "EPA-1", "r2", "Rule", False, "because"), ("TEST-1", "Trial", day, "T", "TEST", None, "Rule", False, None),
        ("EPA-1-6", "Six", day, "EPA", "EPA-1", "r1", "Rule", False, None), ("EPA-1-6", "Six", day, "DOT", "DOT-4", "r1", "Rule", False, None), ("EPA-1-7", "Seven", "2024-05-06", "EPA", "EPA-1", "r1", "Rule", False, None),
    ]
    renditions = [("EPA-1-1", "content", "b"), ("EPA-1-1", "content", "a"), ("EPA-1-1", "attachment", "z"), ("EPA-1-6", "attachment", "c"), ("EPA-1-2", "content", "d"), ("EPA-1-7", "content", "e")]
    dockets = catalog.unique_index(spark.createDataFrame([("EPA-1",), ("EPA-2",)], "id string"), F.col("id"))
    register = catalog.unique_index(spark.createDataFrame([("r1",), ("r2",), ("r2",)], "id string"), F.col("id"))
    return spark.createDataFrame(rows, FILED), spark.createDataFrame(renditions, "item string, family string, locator string"), {"docket": dockets, "register-document": register}


def test_catalog_decisions_and_accounts(spark, tmp_path):
    records, renditions, indexes = filings(spark)
    rows = catalogs.build(records, renditions, catalogs.docket_documents(budget=1), indexes)
    got = {r.item: r for r in rows.collect()}
    assert {k: (r.disposition, r.reason_code) for k, r in got.items()} == {
        "EPA-1-1": ("selected", None), "EPA-1-2": ("deleted", "withdrawn"), "EPA-1-3": ("failed", "metadata-missing"), "EPA-1-4": ("unavailable", "no-rendition"),
        "EPA-1-5": ("failed", "unread-restriction"), "TEST-1": ("excluded", "publisher-test-record"), "EPA-1-6": ("excluded", "budget-exhausted"), "EPA-1-7": ("failed", "metadata-missing"),
    }
    assert got["EPA-1-1"].family == "content" and got["EPA-1-1"].candidates == ["a", "b"]
    assert [(j.join, j.outcome) for j in got["EPA-1-4"].joins] == [("docket", "matched"), ("register-document", "no-match")] and got["EPA-1-2"].joins[1].outcome == "not-stated"
    assert [f.outcome for f in got["EPA-1-3"].normalized][:2] == ["unparseable", "normalized"]
    own = catalogs.Catalogs(LayerStore(spark, f"file://{tmp_path}/w"))
    first = own.publish("c", rows)
    own.verify(first)
    stored, account = own.open(first)
    assert account["universe"]["count"] == 8 and account["selected"]["count"] == 1 and stored.count() == 8
    more = catalogs.build(records, renditions, catalogs.docket_documents(), indexes)
    second = own.publish("c", more, supersedes=first)
    assert {(r.item, r.change) for r in own.preview(second, first).where("change <> 'unchanged'").collect()} == {("EPA-1-6", "changed")}
    with pytest.raises(StaleBase):
        own.publish("c", rows.limit(3), supersedes=first)
    with pytest.raises(Refused):
        catalogs.build(records, renditions, catalogs.docket_documents(), {})
    with pytest.raises(Refused):
        catalogs.build(records.select("title", F.lit("x").alias("record_id")), renditions, catalogs.supplied_records())
    assert {r.state for r in catalogs.processing_items(stored).collect()} == {"active", "deleted", "excluded"}


def test_sampled_catalog(spark):
    rows = spark.range(90).select(F.format_string("D-%03d", "id").alias("document_number"), F.lit("t").alias("title"), F.lit("2024-01-02").alias("publication_date"), (F.col("id") % 3).cast("string").alias("kind"))
    renditions = rows.select(F.col("document_number").alias("item"), F.lit("html").alias("family"), F.lit("u").alias("locator"))
    policy = catalogs.register_documents()
    policy = catalogs.Policy(policy.name, policy.item, policy.fields, policy.required, families=policy.families, sample=catalogs.Sample("kind", ("publication_date",), "7", 5))
    out = catalogs.build(rows, renditions, policy)
    assert out.where("disposition = 'selected'").count() == 15 and out.where("reason_code = 'not-drawn'").count() == 75


def test_operations_run_once_resume_and_correspond(spark, tmp_path):
    ops = operations.Operations(Files(spark, f"file://{tmp_path}/w"))
    calls = []

    def produce(save, saved):
        calls.append(list(saved))
        if not saved:
            save({"done": 1})
            raise RuntimeError("lost")
        return {"rows": 5}

    definition = {"id": "x", "name": "count", "parameters": {"n": 1}}
    with pytest.raises(RuntimeError):
        ops.run_once(definition, {"in": "d1"}, produce)
    result = ops.run_once(definition, {"in": "d1"}, produce)
    assert result.output == {"rows": 5} and result.attempts == 2 and calls == [[], [{"done": 1}]]
    assert ops.run_once({**definition, "id": "y"}, {"in": "d1"}, produce) == result and len(calls) == 2
    assert operations.correspondence(definition, {"in": "d1"}) != operations.correspondence(definition, {"in": "d2"})
    assert ops.inspect(result.correspondence)["checkpoints"] == 1
    deps = [{"label": "a", "digest": "1"}, {"label": "b", "digest": "2"}]
    assert operations.fold(deps, [{"kind": "omit", "label": "a"}, {"kind": "supplement", "label": "c", "digest": "3"}]) == {"b": "2", "c": "3"}
    for bad in ([{"kind": "omit", "label": "z"}], [{"kind": "supplement", "label": "a", "digest": "9"}], [{"kind": "odd", "label": "a"}]):
        with pytest.raises(Refused):
            operations.fold(deps, bad)


def test_resolution_and_selected_outputs(spark):
    requests = spark.createDataFrame([("q1", "c1"), ("q2", "c2"), ("q3", "c2"), ("q4", "c3")], "request_id string, correspondence string")
    results = spark.createDataFrame([("c1", "r2", "success", True), ("c1", "r1", "success", True), ("c3", "r3", "failure", True), ("c2", "r4", "success", False)], "correspondence string, result_id string, outcome string, available boolean")
    reused, todo = operations.resolve_many(requests, results)
    assert [(r.request_id, r.result_id) for r in reused.collect()] == [("q1", "r1")]
    assert {(r.request_id, r.requests) for r in todo.collect()} == {("q2", 2), ("q4", 1)}
    members = spark.createDataFrame([("k", "o1")], "member_key string, occurrence_id string")
    chosen = spark.createDataFrame([("k", "o1", "r1")], "member_key string, occurrence_id string, result_id string")
    outputs = spark.createDataFrame([("r1", "out")], "result_id string, output string")
    assert operations.selected_outputs(members, chosen, outputs).first().output == "out"
    for args in ((members.withColumn("occurrence_id", F.lit("o2")), chosen, outputs), (members, chosen, outputs.limit(0))):
        with pytest.raises(Refused):
            operations.selected_outputs(*args)
    column = spark.createDataFrame([("{}", {"b": "2", "a": "1"}), ("{}", {"a": "1", "b": "2"})], "d string, e map<string,string>").select(operations.correspondence_column("d", "e").alias("c"))
    assert column.distinct().count() == 1


def test_document_run_reuses_what_is_retained(spark):
    items = spark.createDataFrame([("i1", "active", ["a", "b"]), ("i2", "active", ["c"]), ("i3", "excluded", ["a"])], "item string, state string, candidates array<string>")
    files = spark.createDataFrame([("a", "text/plain", b"one two\n\nthree"), ("b", "text/html", b"<p>one two</p>"), ("c", "application/json", b'[{"x":1}, 2]')], "locator string, media string, content binary")
    seen = []

    def count(rows, _):
        seen.append(rows.count())
        return documents.segment_statistics(rows, ["segment_id"])

    processors = [pipeline.Processor("stats", "1", count), pipeline.Processor("long", "1", lambda s, o: o["stats"].where("word_count > 1").select("segment_id"), ("stats",))]
    found, outputs, summary = pipeline.run(items, files, processors)
    assert {r.item: (r.representations, r.segments) for r in summary.collect()} == {"i1": (2, 3), "i2": (1, 2), "i3": (0, 0)}
    assert found.count() == 5 and outputs["long"].count() == 2 and seen == [5]
    _, again, _ = pipeline.run(items, files, processors[:1], retained={"stats": outputs["stats"]})
    assert seen == [5, 0] and again["stats"].count() == 5
    bounded, _, _ = pipeline.run(items, files, [pipeline.STATISTICS], bounds=segments.Bounds(2, 1, 1))
    assert bounded.count() >= 5
    with pytest.raises(LimitExceeded):
        pipeline.run(items, files, [], most_bytes=3)
    with pytest.raises(Refused):
        pipeline.run(items, files, [processors[1]])


def test_command_line(spark, tmp_path):
    def call(*args):
        return cli.run(cli.parser().parse_args(["--root", f"file://{tmp_path}/w", *args]), spark)

    (tmp_path / "a.jsonl").write_text('{"key":"a","value":1}\n{"key":"b","value":2}\n')
    (tmp_path / "b.jsonl").write_text('{"key":"b","value":3}\n')
    first = call("create", f"file://{tmp_path}/a.jsonl", "b1", "--dataset", "d")["state"]
    second = call("upsert", "d", f"file://{tmp_path}/b.jsonl", "b2")["state"]
    assert [r["value"] for r in call("rows", second)] == ["1", "3"]
    assert call("compare", first, second)["counts"] == [{"change": "changed", "n": 1}]
    assert call("inspect", call("checkpoint", second)["state"])["rows"] == 2
    assert call("execute", "test_plans:doubled", first, "b3")["state"] != first
    assert call("select", "d", first, "--expected", second)["state"] == first
    assert call("export", second, f"file://{tmp_path}/x")["pin"] and isinstance(call("remove", f"{first},{second}")["removed"], list)


def doubled(rows):
    return rows.select("member_key", (F.col("value").cast("int") * 2).cast("string").alias("value"))

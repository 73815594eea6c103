import hashlib
import re

from conftest import prose

from sedimenta.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UP))


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        k = min(n, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def items(spark):
    rows = [(1, prose(1, 300)[40:400]), (2, None), (3, ""), (4, "Two, words!"), (5, prose(3, 150)[:300]), (5, prose(3, 150)[:300]), (10, "é😀 naïve é"), (None, "zzz yyy")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_report_equals_brute_force(spark, docs):
    rows, bench = items(spark)
    for window, most in ((10, 64 << 20), (10, 5000), (4, 64 << 20)):
        got = d.digest_columns(d.scan_documents(docs, bench, window=window, max_broadcast_bytes=most)).collect()
        want = sorted((r.doc_id or 0, *brute(r.text, [x for x in rows if x[0] is not None], window)) for r in docs.collect())
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_clean_drops_and_cuts(spark, docs):
    rows, bench = items(spark)
    kept = d.clean(docs, bench)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not brute(r.text, rows)[4]}
    few = {"max_broadcast_bytes": 5000}
    assert sorted(map(repr, d.clean(docs, bench, **few).collect())) == sorted(map(repr, kept.collect()))
    assert sorted(map(repr, d.clean(docs, bench, action="cut", **few).collect())) == sorted(map(repr, d.clean(docs, bench, action="cut").collect()))
    cut = {r.doc_id: r.text for r in d.clean(docs, bench, action="cut").collect()}
    assert all(not brute(t, rows)[4] for t in (cut[7], cut[8], cut[13])) and cut[13] == prose(4, 40) and cut[4] is None


def test_empty_tables(spark, docs, no_docs):
    _, bench = items(spark)
    assert d.digest_columns(d.scan_documents(no_docs, bench)).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.digest_columns(d.scan_documents(docs, empty)).where("contaminated").count() == 0
    assert d.clean(spark.createDataFrame([(1, "x", "t", "i")], "doc_id long, text string, t string, items string"), bench).columns == ["doc_id", "text", "t", "items"]

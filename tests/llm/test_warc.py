import base64
import hashlib
import random

from sedimenta.llm import warc as w

PAGE = "page_id long, url string, html string, payload string"


def rows():
    r = random.Random(1)
    out = [(i, f"http://www.Site{i % 7}.example.org:80/p/{i % 13}?q={i}", f"<p>{i % 9}</p>" * (i % 5), "x") for i in range(60)]
    return out + [(100, None, None, None), (101, "http://a.b/", "", "y"), (None, "not a url", "<p>1</p>", None), (7, out[7][1], out[7][2], "x"), (200, "https://u@a.b/é", "é😀\r\n\r\n" * r.randrange(9, 20), "z")]


def want(data, least=0):
    keepers = {}
    for p, _, h, _ in data:
        k = (h or "").encode()
        keepers[k] = max(keepers.get(k, -1), -1 if p is None else p)
    out, used = [], set()
    for p, _, h, _ in data:
        k = (h or "").encode()
        keeper = keepers[k]
        first = (-1 if p is None else p) == keeper and (p, k) not in used
        used.add((p, k))
        response = first or len(k) < least
        out.append((p, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if response else "revisit", None if response else keeper))
    return sorted(out, key=repr)


def test_report(spark):
    data = rows()
    pages = spark.createDataFrame(data, PAGE)
    for least in (0, 9):
        assert sorted((tuple(r) for r in w.archive_report(pages, least_revisit=least).collect()), key=repr) == want(data, least)
    assert w.archive_report(spark.createDataFrame([], PAGE)).count() == 0


def test_histories_are_in_order_and_payloads_come_back(spark):
    data = rows()
    manifest, folder = w.write_archives(spark.createDataFrame(data, PAGE))
    index = w.capture_histories(manifest, folder)
    got = index.orderBy("part", "seq").collect()
    keys = [(r.url_key, r.time, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == len(data)
    texts = {r.page_id: bytes(r.payload) for r in w.read_records(index, folder, payloads=True).where("record_type = 'response'").collect()}
    assert texts[200].decode() == data[-1][2]


def test_runs_are_merged_in_rounds(spark, monkeypatch):
    data = rows()
    manifest, folder = w.write_archives(spark.createDataFrame(data, PAGE).repartition(3))
    merged = w.merge_rounds(manifest, folder, 2)
    assert manifest.count() == 3 and merged.count() == 2
    names = [r.run for r in merged.collect()]
    entries = [[k for k, _ in w.read_run(folder, n, None, None)] for n in names]
    assert all(e == sorted(e) for e in entries) and sum(map(len, entries)) == len(data)
    monkeypatch.setattr(w, "FAN_IN", 2)
    keys = [(r.url_key, r.time) for r in w.capture_histories(manifest, folder).orderBy("part", "seq").collect()]
    assert keys == sorted(keys) and len(keys) == len(data)


def test_hot_payloads_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(w, "LEAST_HOT", 3)
    data = rows()
    assert sorted((tuple(r) for r in w.archive_report(spark.createDataFrame(data, PAGE)).collect()), key=repr) == want(data)


def test_loser_tree():
    r = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(0, 20))) for _ in range(k)]
        merged = list(w.merge([iter([(x, x) for x in run]) for run in runs]))
        assert merged == sorted(x for run in runs for x in run)


def test_url_keys():
    assert w.url_key("http://www.Example.com:80/A/b?c=D#f") == "com,example)/a/b?c=d"
    assert w.url_key("https://x.y") == "y,x)/" and w.url_key(None) == "" and w.url_key("odd") == "odd"

import collections
import hashlib
import random

import numpy as np

from sedimenta.llm import suffix_dedup as s


def brute(texts, size=400):
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(s.report(s.remove_repeats(frame)).collect())
    assert [tuple(r)[1:] for r in got] == brute([(t or "").encode() for t in texts])


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, passage = text(400), text(90)
    out = [shared, shared, shared[:700], "x" * 1500, "x" * 401, "ab" * 600, None, "", "short", text(300)]
    out += [text(r.randrange(5, 120)) + passage + text(r.randrange(5, 120)) for _ in range(25)]
    out += [shared[: 300 + 37 * i] + text(20) + shared[200 + 31 * i :] for i in range(8)]
    return out


def test_against_brute_force(spark):
    check(spark, corpus())


def test_large_buckets_take_narrow_slabs_and_sub_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "LARGEST", 3)
    parts, sort = [], s._sort_in_parts
    monkeypatch.setattr(s, "_sort_in_parts", lambda slabs, sizes, keep: parts.append(sizes.agg({"m": "max"}).first()[0]) or sort(slabs, sizes, keep))
    check(spark, corpus(1))
    assert max(parts) > 6  # several sub-blocks a bucket


def test_hot_anchors_and_classes(spark, monkeypatch):
    monkeypatch.setattr(s, "LEAST_HOT", 2)
    check(spark, corpus(2))


def test_equal_runs_of_a_text_are_one_row(spark):
    rows = spark.createDataFrame([(1, 2, bytearray(b"x" * 90000))], "k1 long, k2 long, t binary")
    runs = s._occurrences(rows).collect()
    assert len(runs) < 10 and sum(len(r.starts) * r.n for r in runs) == 90000 - 399


def test_rows_of_the_fixture(spark, docs, no_docs):
    rows = docs.collect()
    got = s.report(s.remove_repeats(docs.withColumnRenamed("lang", "t"))).collect()
    want = brute([(r.text or "").encode() for r in rows])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert s.report(s.remove_repeats(no_docs)).count() == 0


def test_cover_and_suffix_order():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))
    r = random.Random(3)
    body = bytes(r.choice(b"ab") for _ in range(900))
    flags = s.repeated_starts([(0, 300, 1, body[:699]), (0, 200, 1, body[100:699]), (1, 200, 1, body[100:699]), (2, 5, 2, body[:404])])
    text = body[:699]
    starts = [(0, text[i : i + 400]) for i in range(300)] + [(0, body[100:699][i : i + 400]) for i in range(200)]
    n = collections.Counter(starts)
    assert flags[:500].tolist() == [n[x] > 1 for x in starts]
    assert not flags[500:700].any() and flags[700:].all()


def test_slabs_alone_in_their_bucket_are_not_sorted(monkeypatch):
    r = random.Random(5)
    both = r.randbytes(500)
    # A hundred lone slabs, every fourth of a class that stands twice, and one bucket of two slabs.
    rows = [(i, i, b"d%d" % i, 0, 101, 0, 2 if i % 4 == 0 else 1, r.randbytes(500)) for i in range(100)]
    rows += [(100, 100 + i, b"e", 0, 101, 0, 1, both) for i in range(2)]
    found, sorted_slabs, plain = [], [], s.repeated_starts

    class Here:
        def mapInArrow(self, search, _):
            for batch in search(iter([s._slab_batch(rows[:60]), s._slab_batch(rows[60:])])):
                found.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))

    monkeypatch.setattr(s, "_dealt", lambda slabs: Here())
    monkeypatch.setattr(s, "repeated_starts", lambda members: sorted_slabs.extend(members) or plain(members))
    s._sort_buckets(None)
    assert sorted(found) == sorted((h, d, 0, 101) for _, h, d, _, _, _, w, _ in rows if w > 1 or h >= 100)
    assert len(sorted_slabs) <= 6  # the bucket of two and the ends of batches


def test_who_is_alone():
    assert s._alone(np.array([1, 2, 3, 3, 4, 5, 5, 6, 7])).tolist() == [False, True, False, False, True, False, False, True, False]
    assert not s._alone(np.array([1])).any() and not s._alone(np.zeros(0)).any()

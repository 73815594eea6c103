import hashlib
import math

from sedimenta.llm import mixing as m


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        level = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if level[s] > most * sizes[s]]
        if not above:
            return capped | level
        capped |= {s: most * sizes[s] for s in above}


def brute(rows):
    sized = [(d, s, len((t or "").encode().split())) for d, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    targets, out = brute_targets(sizes), []
    for s in sizes:
        own = [x for x in sized if x[1] == s]
        ratio = targets[s] / sizes[s] if sizes[s] else 0
        sure = min(math.floor(ratio), 2)
        p, got, lack = ratio - sure, 0, targets[s] - sure * sizes[s]

        def rank(x, p=p):
            u = (int(hashlib.sha256(f"{m.SEED}:{x[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return ((u / (1 - u)) / (p / (1 - p)), x[0], x[2])

        for x in sorted(own, key=rank) if p > 0 else own:
            extra = p > 0 and got < lack and abs(got + x[2] - lack) <= abs(got - lack)
            got += x[2] if p > 0 else 0
            out.append((x[0], x[2], sizes[s], targets[s], x[2] * (sure + extra)))
    return sorted(out)


def test_report_equals_brute_force_and_reruns_agree(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.where("doc_id is not null").collect()] + [(1000 + i, "w " * (i % 40), ["a", "b", "c", None, "z"][i % 5]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(tuple(r) for r in m.mix_report(frame).collect())
    want = brute(rows)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(math.isclose(g[3], w[3]) for g, w in zip(got, want, strict=True))
    assert got == sorted(tuple(r) for r in m.mix_report(frame.repartition(7)).collect())


def test_taken_words_come_near_targets(spark, sf):
    rows = m.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target, largest = {}, {}, 0
    docs = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        s = docs[r.doc_id]
        taken[s], target[s], largest = taken.get(s, 0) + r.taken, r.target, max(largest, r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= largest for s in taken)


def test_mixed_keeps_columns_and_repeats_rows(spark, docs, no_docs):
    report = {r.doc_id: r for r in m.mix_report(docs.where("doc_id is not null")).collect()}
    out = m.mixed(docs.where("doc_id is not null"))
    assert m.mixed(docs.where("doc_id is null or doc_id > 8")).where("doc_id is null").count() in (1, 2)
    assert out.schema == docs.schema
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts.get(d, 0) == r.taken // r.size for d, r in report.items() if r.size and d != 2)
    assert m.mix_report(no_docs).count() == 0 and m.mixed(no_docs).count() == 0
    assert m.mix_report(docs).count() == docs.count()

import math

import numpy as np

from sedimenta.llm import embeddings as e


def brute(rows, least=0.93):
    good = {}
    for i, (v, x, l) in enumerate(rows):
        if l is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            a = np.array(x, np.float32).astype(float)
            good[i] = (a / np.linalg.norm(a), l, len(x))
    links = {i: [j for j in good if j != i and good[j][1:] == good[i][1:] and good[i][0] @ good[j][0] >= least] for i in good}
    comp = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((v, len(links.get(i, [])), comp[i], v is None or comp[i] == v) for i, (v, _, _) in enumerate(rows)), key=repr)


def data(n=700, dim=16):
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, dim))
    rows = [(i, (centres[i % 60] * r.uniform(0.1, 9) + r.normal(size=dim) * 0.18).tolist(), i % 3) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [1.0, None] + [0.0] * (dim - 2), 1), (n + 4, [float("nan")] * dim, 1), (n + 5, [float("inf")] + [0.0] * (dim - 1), 1)]
    odd += [(n + 6, rows[0][1], None), (None, rows[0][1], 0), (n + 7, rows[5][1][:8], 2), (n + 8, rows[5][1][:8], 2), (n + 9, [1e30] * dim, 0), (n + 10, [2e30] * dim, 0)]
    return rows + odd


SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def test_links_and_components(spark):
    rows = data()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in e.link_embeddings(frame, shard=128).collect()), key=repr)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.97 * true <= found <= true
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert e.link_embeddings(frame.where("false")).count() == 0


def test_search_recall_and_widening():
    r = np.random.default_rng(9)
    v = r.normal(size=(900, 24))
    v[:400] = v[0] + 0.05 * r.normal(size=(400, 24))  # a dense group, larger than a beam
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = e.Graph.unpack(e.Graph(v).pack(), v)
    found = g.search(v, 64)
    top = np.argsort(-(v @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(found[i]) & set(top[i])) / 10 for i in range(400, 900)]) >= 0.9
    a, b = e._links(g, v, v, 0.93, 0.99)
    true = (v @ v.T >= 0.93).sum()
    assert len(a) >= 0.97 * true and (np.einsum("ij,ij->i", v[a], v[b]) >= 0.93 - 1e-12).all()


def unit(v):
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_small_shards_are_searched_by_their_graph(monkeypatch):
    r = np.random.default_rng(2)
    v = unit(np.repeat(r.normal(size=(100, 16)), 2, axis=0) + 0.05 * r.normal(size=(200, 16)))
    g, searched, search = e.Graph(v), [], e.Graph.search
    monkeypatch.setattr(e.Graph, "search", lambda self, q, beam: searched.append(len(q)) or search(self, q, beam))
    a, _ = e._links(g, v, v, 0.93, 0.99)
    assert max(searched, default=0) == len(v) and len(a) >= 0.99 * (v @ v.T >= 0.93).sum()


def test_recall_of_the_graph_in_large_shards():
    r = np.random.default_rng(6)
    v = unit(np.repeat(r.normal(size=(900, 24)), 2, axis=0) + 0.1 * r.normal(size=(1800, 24)))
    a, b = e._links(e.Graph(v), v, v, 0.93, 0.99)
    found = np.zeros((len(v), len(v)), bool)
    found[a, b] = True
    assert e._recall(found, v @ v.T >= 0.93) >= 0.99


def test_audit_notices_what_its_own_queries_cannot():
    """No audited query has a link, and a twentieth of the shard cannot be reached."""
    r = np.random.default_rng(5)
    v, q = unit(r.normal(size=(900, 24))), unit(r.normal(size=(600, 24)))
    cut = np.arange(3, 900, 20)
    mine = np.setdiff1d(np.arange(600), np.linspace(0, 599, e.AUDIT).astype(int))[: len(cut)]
    q[mine] = v[cut]
    g = e.Graph(v)
    for links in g.links:
        links[np.isin(links, cut)] = -1
    a, b = e._links(g, v, q, 0.93, 0.99)
    assert set(zip(mine.tolist(), cut.tolist())) <= set(zip(a.tolist(), b.tolist()))


def test_audits_are_told_and_shards_do_not_depend_on_the_run(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in data()], SCHEMA)
    results = [e.find_links(rows.repartition(k), shard=128) for k in (1, 3)]
    (one, told), (other, _) = results
    assert sorted(one.collect(), key=repr) == sorted(other.collect(), key=repr)
    audits = told.collect()
    assert len(audits) > 6 and all(min(a.own_recall, a.probe_recall) >= e.RECALL for a in audits)
    assert any(a.beam > 0 for a in audits) and sum(a.own_queries for a in audits) > 0


def test_links_within_and_across_shards_are_those_of_the_vectors():
    """Dense groups, larger than a beam, next to pairs and single vectors."""
    r = np.random.default_rng(8)
    v = unit(np.concatenate((r.normal(size=(1, 24)) + 0.05 * r.normal(size=(200, 24)), np.repeat(r.normal(size=(150, 24)), 2, axis=0) + 0.03 * r.normal(size=(300, 24)), r.normal(size=(100, 24)))))
    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    counts, edges, audit = e._within(e.Graph(v), v, 0.93, 0.99)
    assert audit.own >= e.AUDIT and (counts <= true.sum(axis=1)).all() and counts.sum() >= 0.99 * true.sum()
    assert len(edges) == 199 + 150
    a, b = v[::2], v[1::2]
    mine, theirs, edges, _ = e._across(e.Graph(b), b, a, 0.93, 0.99)
    assert mine.sum() == theirs.sum() >= 0.99 * (a @ b.T >= 0.93).sum() and len(edges) == 199 + 150

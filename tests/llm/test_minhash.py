import random

import numpy as np
import pytest
from conftest import prose

from sedimenta.llm import minhash as m
from sedimenta.llm.components import connected_components


def brute(rows, k, percent):
    sets = [m.shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    r = random.Random(2)
    base = prose(20, 120).split()
    rows = [(1000, " ".join(base)), (1001, "one two"), (1002, "ONE  two"), (1003, None), (1004, ""), (1005, " \n")]
    for i in range(60):  # a group whose members link through others
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"w{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # a chain: neighbours link, ends do not
        w = list(base)
        w[: 3 * i] = [f"c{j}" for j in range(3 * i)]
        rows.append((500 + i, " ".join(w)))
    return rows + [(200 + i, prose(100 + i % 4, 60 + i)) for i in range(8)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)
    rows = corpus()
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, percent)


def test_rows_of_the_fixture(spark, docs, no_docs):
    got = m.near_duplicates(docs, k=3, percent=85).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and by[2].component_id == 1 and by[3].component_id == 1 and by[None].component_id == 1 and by[None].kept
    assert by[8].component_id == 7 and by[4].component_id == 4 and by[4].n_shingles == 0 and by[10].kept
    kept = m.keep_one(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14}
    assert m.near_duplicates(no_docs).count() == 0


def test_rows_that_share_an_id_are_one_vertex(spark):
    a, b = prose(31, 50), prose(32, 50)
    rows = [(5, a), (5, b), (3, a), (9, b)]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.component_id for r in got} == {3}


def test_sketches_fill_and_agree_as_the_sets_do():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 1000, dtype=np.uint64))
    b = np.concatenate((a[:800], np.unique(r.integers(0, 1 << 62, 200, dtype=np.uint64))))
    s = m.sketches([a, b, a[:1]], 512)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08
    assert m.bands_for(0.85) * np.log(1 - 0.85**m.ROWS) <= np.log(m.MISS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (7, None), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from sedimenta.llm import common
    from sedimenta.llm.components import connected_components

    edges = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(59, 100), (200, 201), (7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(60)} | {i: 0 for i in range(100, 140)} | {200: 200, 201: 200}
    for least in (common.LEAST_HOT, 5):
        monkeypatch.setattr("sedimenta.llm.components.LEAST_HOT", least)
        assert {r.id: r.component for r in connected_components(frame).collect()} == want


def test_no_machine_local_folder_on_a_cluster(spark):
    import pytest

    from sedimenta.llm.common import shared_root

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_root(Session())

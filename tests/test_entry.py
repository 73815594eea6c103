import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for n in entry._core.queries() if n in entry._core_sql.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.11g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def test_entry(spark):
    assert {r.change for r in entry.entry(spark).collect()} == {"changed", "removed"}


def test_registers_name_each_other():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, sf, duck, name):
    frame = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry._core.queries()) - set(CORE)))
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0

"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from veriloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _plain(rows, names):
    order = sorted(names)
    take = [names.index(n) for n in order]
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(clean(r[k]) for k in take) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _plain(rows, df.columns) == _plain(want.fetchall(), want.columns)


def test_queries_don_t_depend_on_partitions(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([_plain([tuple(r) for r in catalogue.QUERIES[q](spark, SF).collect()], catalogue.QUERIES[q](spark, SF).columns) for q in ("g02_consensus", "o02_bm25", "i14_unique_keys", "r03_merge")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]

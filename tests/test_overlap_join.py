"""overlap_join: the tasks that read the passages give what joins give, and texts aren't exploded over a shuffle."""

from veriloom.operators import retrieval

QUERIES = [(0, "Red houses stand near rivers; red birds sing"), (1, "houses"), (2, "the of and"), (3, None), (4, "birds sing, birds sing, and rivers run"), (5, "zebra")]
PASSAGES = [(0, "red houses stand near the rivers"), (1, "Birds sing. The red bird sings near houses"), (2, ""), (3, None), (4, "x " * 3000 + "rivers running"), (5, "of the"), (6, "birds sing"), (6, "rivers run"), (None, "houses"), (7, "houses houses houses")]


def test_as_by_joins(spark):
    q = spark.createDataFrame(QUERIES, "query_id int, query string")
    p = spark.createDataFrame(PASSAGES, "id long, text string")
    rows = lambda df: sorted(((r["query_id"], r["id"], round(r["overlap"], 12)) for r in df.collect()), key=str)
    got = retrieval.overlap_join(q, p, nfkc=False)
    assert rows(got) == rows(retrieval._overlap_by_joins(q, p, False))
    assert got.count() > 10
    alone = retrieval.overlap_join(q, p.where("id < 6"), nfkc=False)
    assert rows(alone) == rows(retrieval._overlap_by_joins(q, p.where("id < 6"), False))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert rows(retrieval.overlap_join(q.where("query_id = 3"), p)) == [] == rows(retrieval.overlap_join(q, p.where("false")))

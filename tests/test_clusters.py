"""Clusters of values in one pass over the rows."""

from folioframe.operators import sequences


def test_clusters_without_a_join(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 30), (1, 56), (1, None), (2, 5), (None, 5)], "page_id bigint, x int")
    out = sequences.clusters(df, ["page_id"], "x", 25)
    assert sorted(map(tuple, out.collect())) == [(1, 5, 1), (1, 5, 1), (1, 30, 1), (1, 56, 2), (2, 5, 1)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()

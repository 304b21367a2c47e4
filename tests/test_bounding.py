"""The nearest lines around items, by hand and without sorting items by position."""

from folioframe.operators import spatial


def test_lines_around_items(spark):
    items = spark.createDataFrame([(1, 1, 10, 10, 31, 30), (1, 2, 0, 0, 10, 10), (2, 1, 0, 0, 10, 10), (None, 1, 0, 0, 10, 10)], "page_id bigint, item_id bigint, x1 int, y1 int, x2 int, y2 int")
    lines = spark.createDataFrame([(1, "h", 20), (1, "h", 20), (1, "v", 19), (1, "v", 25), (1, "v", 40), (None, "h", 5), (3, "h", 5)], "page_id bigint, orient string, pos int")
    df = spatial.bounding_lines(items, lines, 100, 90)
    found = sorted(map(tuple, df.collect()), key=str)
    assert found == [(1, 1, 19, 20, 25, 20), (1, 2, 0, 0, 19, 20), (2, 1, 0, 0, 100, 90), (None, 1, 0, 0, 100, 90)]
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()

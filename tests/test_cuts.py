"""Cuts of pages: gaps and choice in one call a page."""

from conftest import SF

from folioframe.functions.greedy import best_splits
from folioframe.operators import tiling
from folioframe.plans import catalog


def test_cuts_by_hand(spark):
    items = spark.createDataFrame([(1, 300, 500), (1, None, 100), (1, 520, None), (2, 0, 1000), (3, 10, 20), (5, 600, 700)], "page_id bigint, x1 int, x2 int")
    pages = spark.createDataFrame([(1, 1000), (2, 1000), (4, 1000), (5, None), (None, 1000)], "page_id bigint, w int")
    assert [tuple(r) for r in tiling.axis_cuts(items, pages, "x", "w", 400).collect()] == [(1, "v", 200), (1, "v", 600)]
    assert best_splits([(130, 270)], 1000, 400) == [200, 600]  # the one gap that is left


def test_spans_are_dealt_once(spark):
    """Windows and joins over the spans held their rows several times, in tasks joined by packed bytes."""
    plan = catalog.QUERIES["smart_cuts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1  # that of the items

"""Cells of a page's lines against the relational steps, on few and on many lines."""

import random

from folioframe.operators import grouping, spatial


def _lines(seed, pages, n):
    rng = random.Random(seed)
    return [(p, rng.choice("hv"), rng.randrange(0, 900), lo, lo + rng.randrange(0, 500)) for p in range(pages) for _ in range(n) for lo in [rng.randrange(0, 700)]]


def _by_steps(lines):
    anchors = grouping.anchored_lines(lines)
    at = lines.join(anchors, ["page_id", "orient", "pos"]).select("page_id", "orient", "anchor", "lo", "hi").withColumnRenamed("anchor", "pos")
    return spatial.closed_sides(spatial.grid_cells(spatial.line_crossings(at)), at).select("page_id", *spatial.BOX)


def test_cells_of_lines_as_by_steps(spark):
    rows = [*_lines(1, 20, 12), *[(100 + r[0], *r[1:]) for r in _lines(2, 3, 300)]]
    lines = spark.createDataFrame(rows, "page_id bigint, orient string, pos int, lo int, hi int")
    found = sorted(map(tuple, grouping.enclosed_cells(lines).collect()))
    assert len(found) > 50 and found == sorted(map(tuple, _by_steps(lines).collect()))


def test_cells_are_not_met_with_segments(spark):
    """Joining the sides of all cells to all segments of the page held a gigabyte a task at a tenth of one."""
    from conftest import SF

    from folioframe.plans import catalog

    assert "Join" not in catalog.QUERIES["intersection_grid"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()

"""Crossed lines by running sums against all pairs."""

import random

from conftest import SF

from folioframe.operators import spatial
from folioframe.plans import catalog


def test_crossings_as_by_pairs(spark):
    rng = random.Random(3)
    rows = [(p, rng.choice("hv"), rng.randrange(0, 300), lo, lo + rng.randrange(-250, 200)) for p in range(8) for _ in range(40) for lo in [rng.randrange(0, 300)]]
    rows += [(9, "h", 5, 0, 10), (9, "v", 115, 0, 0), (9, "v", 110, 0, 0), (9, "v", -95, 0, 9), (9, "h", 6, 0, 10), (9, "h", 6, 5, 10), (9, "h", 6, None, 10), (None, "h", 1, 0, 10), (None, "v", 1, 0, 10), (9, "h", None, 0, 99)]
    expected = {}
    for p, o, at in {r[:3] for r in rows}:
        met = {b[2] for b in rows if p is not None and b[0] == p and b[1] != o and None not in (at, *b) and b[3] - 100 <= at <= b[4] + 100}
        if len(met) >= 2:
            expected[p, o, at] = len(met)
    got = spatial.line_crossings(spark.createDataFrame(rows, "page_id bigint, orient string, pos int, lo int, hi int")).collect()
    assert {tuple(r)[:3]: r.crossings for r in got} == expected and len(got) == len(expected) > 20


def test_lines_do_not_meet_in_pairs(spark):
    """All pairs of a page's lines were held by the few tasks that Spark leaves for narrow rows."""
    df = catalog.QUERIES["line_crossings"](spark, SF)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()

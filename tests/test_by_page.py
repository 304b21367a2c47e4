"""merged_items goes by page: its items are dealt by page once, and lists of a page's cells give what the join by square gives."""

import re

import numpy as np
from conftest import SF

from folioframe.operators import grouping, spatial
from folioframe.plans import catalog

BOX = "page_id bigint, x1 int, y1 int, x2 int, y2 int"


def test_items_are_dealt_by_page_alone(spark, monkeypatch):
    steps = []
    keep = grouping.stored
    monkeypatch.setattr(grouping, "stored", lambda df: steps.append(df) or keep(df))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        catalog.QUERIES["merged_items"](spark, SF)
        plan = steps[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "item_id" in k or "gx" in k]
    # by part, by page for items, by page for the cells' borders and lists; page numbers are dealt for the cells
    assert len([k for k in keys if "l_partkey" in k or "p_partkey" in k]) == 2 and plan.count("SortMergeJoin") == 3


def test_cell_lists_give_what_the_join_gives(spark):
    rng = np.random.default_rng(5)

    def boxes(n, most):
        at = rng.integers(-600, 1500, (n, 2))
        return np.concatenate([rng.integers(0, 3, (n, 1)), at, at + rng.integers(-5, most, (n, 2))], 1).tolist()

    rows = [(p, k, *b) for k, (p, *b) in enumerate(boxes(400, 150))] + [(None, 900, 0, 0, 9, 9), (1, 901, None, 0, 9, 9), (7, 902, 0, 0, 9, 9)]
    items = spark.createDataFrame(rows, "page_id bigint, item_id bigint, x1 int, y1 int, x2 int, y2 int")
    cells = spark.createDataFrame([tuple(b) for b in boxes(300, 900)] * 2 + [(None, 0, 0, 9, 9), (1, 0, None, 9, 9)], BOX)
    want = {(r.page_id, r.item_id, r.c_x1, r.c_y1, r.c_x2, r.c_y2) for r in spatial.best_cell(items, cells).collect()}
    got = spatial.with_best_cell(items, cells).collect()
    assert len(got) == len(rows) and {(r.page_id, r.item_id, r.c_x1, r.c_y1, r.c_x2, r.c_y2) for r in got if r.c_x1 is not None} == want and len(want) > 150

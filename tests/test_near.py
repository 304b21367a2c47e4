"""Near-duplicates of whole pages: pairs by brute force, links instead of all comparisons, and no join of items with their partners."""

import numpy as np
import pytest
from conftest import SF

from folioframe.functions import greedy
from folioframe.operators import grouping
from folioframe.operators.paging import of_pages
from folioframe.plans import catalog


def boxes_of(rng, n, wide=60):
    at = rng.integers(-20, 60, (n, 2))
    return np.concatenate([at, at + rng.integers(-3, wide, (n, 2))], 1)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_agreeing_boxes_by_brute_force(most):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 120):
        page, boxes = rng.integers(0, 4, n), boxes_of(rng, n)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if page[i] == page[j] and greedy.iou(tuple(boxes[i]), tuple(boxes[j])) >= 0.45}
        got = [tuple(sorted((int(x), int(y)))) for a, b in greedy.agreeing(page, boxes, 0.45, most) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_give_what_all_comparisons_give():
    rng = np.random.default_rng(4)
    for _ in range(60):
        boxes = boxes_of(rng, 40)
        items = [{"id": k % 37, "text": "abcdefgh"[: rng.integers(0, 9)], "box": tuple(map(int, b)), "confidence": rng.integers(0, 4) / 50} for k, b in enumerate(boxes)]
        near = [[] for _ in items]
        for a, b in greedy.agreeing(np.zeros(40, int), boxes, 0.45):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                near[x].append(y)
                near[y].append(x)
        assert greedy.deduplicated(items, near=near) == greedy.deduplicated(items)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_odd_rows_stay(spark, monkeypatch, most):
    """Rows without a page, a number or a box meet nothing; page numbers beyond 2 ** 53 stay apart; with many pairs items are compared one by one."""
    monkeypatch.setattr(grouping, "MOST_PAIRS", most)
    big = 2**60
    rows = [(p, i, t, *b, c, "s", 0.0) for p, i, t, b, c in [
        (None, 1, "a", (0, 0, 10, 10), 0.9), (None, 2, "a", (0, 0, 10, 10), 0.9), (big, 1, "a", (0, 0, 10, 10), 0.9), (big + 1, 1, "a", (0, 0, 10, 10), 0.9), (big + 1, 2, "a", (0, 0, 10, 10), 0.8),
        (big + 1, 3, None, (0, 0, 10, 10), None), (big + 1, None, "a", (0, 0, 10, 10), 0.9), (big + 1, 4, "a", (0, None, 10, 10), 0.9), (2, 5, "a", (0, 0, 10, 10), 0.5), (2, 5, "a", (0, 0, 10, 10), 0.4)]]
    got = grouping.deduplicated(spark.createDataFrame(rows, grouping.ITEM)).collect()
    assert sorted((str(r.page_id), str(r.item_id)) for r in got) == sorted(map(lambda x: (str(x[0]), str(x[1])), [(None, 1), (None, 2), (big, 1), (big + 1, 1), (big + 1, None), (big + 1, 4), (2, 5), (2, 5)]))


def test_pages_come_whole_over_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        df = spark.range(40).selectExpr("IF(id < 4, NULL, id DIV 7) AS page_id", "id")

        def first(rows):
            return rows.filter([k == 0 or p is None or p != rows["page_id"][k - 1].as_py() for k, p in enumerate(rows["page_id"].to_pylist())])

        got = [(r.page_id, r.id) for r in of_pages(df, first).collect()]
        assert len([g for g in got if g[0] is None]) == 4 and sorted(g[0] for g in got if g[0] is not None) == [0, 1, 2, 3, 4, 5]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["recognition_chain", "coarse_to_fine", "greedy_dedup"])
def test_items_are_dealt_once_and_meet_no_partners(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan and plan.count("MapInArrow") == 1

"""The distance to the nearest cell: what touches is found where items and cells are dealt once, the others by widening."""

from random import Random

from test_stages import counted

from folioframe.operators import spatial

BOX = "x1 int, y1 int, x2 int, y2 int"


def test_items_that_touch_cells_are_read_once(spark):
    cells, c = counted(spark.createDataFrame([(p, x, 0, x + 100, 900) for p in range(3) for x in range(0, 1000, 100)], f"page_id bigint, {BOX}"))
    items, i = counted(spark.createDataFrame([(p, k, 7 * k, 8 * k, 7 * k + 40, 8 * k + 9) for p in range(3) for k in range(100)], f"page_id bigint, item_id bigint, {BOX}"))
    got = spatial.nearest_cell_gap(items, cells).collect()
    assert len(got) == 300 and {r.gap for r in got} == {0}
    assert (i.value, c.value) == (300, 30)


def test_gaps_of_all_distances_are_those_of_all_pairs(spark):
    draw = Random(5).randrange
    box = lambda x, y: (x, y, x + draw(1, 90), y + draw(1, 30))
    cells = [(p, *box(draw(0, most), draw(0, most))) for p, most, n in ((0, 700, 9), (1, 60_000, 5), (3, 500, 1)) for _ in range(n)]
    cells += [(2, 412, 0, 512, 10), (None, 0, 0, 9, 9), (2, None, 0, 9, 9)]
    items = [(p, k, *box(draw(0, most), draw(0, most))) for p, most in ((0, 900), (1, 60_000), (3, 9_000), (4, 100)) for k in range(40)]
    items += [(2, 1, 512, 10, 600, 20), (2, 2, 513, 0, 600, 9), (2, 3, 512, 1023, 530, 1024), (0, 1, 5000, 5000, 5010, 5010), (0, 77, 5000, 5000, 5010, 5010), (0, 77, 9000, 0, 9001, 1), (None, 1, 0, 0, 9, 9), (2, 9, None, 0, 9, 9)]
    want = {}
    for p, k, *i in items:
        for q, *c in cells:
            if p == q and p is not None and None not in (*i, *c):
                gap = max(0, c[0] - i[2], i[0] - c[2], c[1] - i[3], i[1] - c[3])
                want[p, k] = min(gap, want.get((p, k), gap))
    got = spatial.nearest_cell_gap(spark.createDataFrame(items, f"page_id bigint, item_id bigint, {BOX}"), spark.createDataFrame(cells, f"page_id bigint, {BOX}")).collect()
    assert {(r.page_id, r.item_id): r.gap for r in got} == want and len(got) == len(want)
    assert {0, 1} <= set(want.values()) and max(want.values()) > 4096

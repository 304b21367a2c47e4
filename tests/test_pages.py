"""Pages are independent: what an operator gives for two pages that use the same item numbers is what it gives for each alone."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, plain
from pyspark.sql import functions as F

from folioframe.functions import raster as kernels
from folioframe.operators import aggregates, fitting, grouping, raster, sequences, spatial, tiling
from folioframe.params import DEFAULT
from folioframe.plans import catalog, flows
from folioframe.plans import views as v
from folioframe.sources import readers

ITEM = "page_id bigint, item_id bigint, text string, x1 int, y1 int, x2 int, y2 int, confidence double, angle double, source string, size double"
CELL = "page_id bigint, x1 int, y1 int, x2 int, y2 int, morph boolean, sides int"


def page(number, seed, n=40):
    r = random.Random(seed)
    items, cells, lines = [], [], []
    for k in range(n):
        x, y = r.randrange(0, 800), r.randrange(0, 600)
        text = r.choice(["alpha", "beta\ngamma", "one two\nthree\nfour", "delta"])
        items.append((number, k, text, x, y, x + r.randrange(20, 160), y + r.randrange(8, 60), r.choice([0.2, 0.5, 0.9, None]), r.choice([0.0, 0.0, 2.0, 90.0, None]), r.choice("ab"), 12.0))
        if k % 4 == 0:  # a second reading of the same text
            items.append((number, n + k, text, x + 1, y, *items[-1][5:7], 0.4, 0.0, "b", 12.0))
    for i in range(4):
        for j in range(4):
            cells.append((number, i * 200, j * 150, i * 200 + 200, j * 150 + 150, r.random() < 0.3, 3 + (i + j) % 2))
            if r.random() < 0.4:
                cells.append((number, i * 200 + 9, j * 150 + 9, i * 200 + 180, j * 150 + 140, r.random() < 0.5, 4))
    for _ in range(14):
        at, lo = r.randrange(0, 800), r.randrange(0, 400)
        lines.append((number, r.choice("hv"), at, lo, lo + r.randrange(50, 500)))
    return items, cells, lines


OPERATORS = {
    "best_cell": lambda i, c, s: spatial.best_cell(i, c),
    "nearest_cell_gap": lambda i, c, s: spatial.nearest_cell_gap(i, c.filter("x1 > 400")),
    "near_gap_far": lambda i, c, s: spatial.nearest_cell_gap(i, c.filter("x1 > 400"), reach=5),
    "without_contained": lambda i, c, s: spatial.without_contained(c),
    "outside_protected": lambda i, c, s: spatial.outside_protected(c),
    "uncovered": lambda i, c, s: spatial.uncovered(i, c),
    "cells_near_text": lambda i, c, s: spatial.cells_near_text(c, i.limit(10**6).filter("item_id < 6")),
    "grid_neighbours": lambda i, c, s: spatial.grid_neighbours(c),
    "line_crossings": lambda i, c, s: spatial.line_crossings(s),
    "grid_cells": lambda i, c, s: spatial.grid_cells(s),
    "closed_sides": lambda i, c, s: spatial.closed_sides(spatial.grid_cells(s), s),
    "bounding_lines": lambda i, c, s: spatial.bounding_lines(i, s, 1000, 800),
    "bounding_cells": lambda i, c, s: spatial.bounding_cells(i, s, 1000, 800),
    "near_duplicates": lambda i, c, s: spatial.near_duplicates(i),
    "nearest_below": lambda i, c, s: spatial.nearest_below(i),
    "nearest_below_strict": lambda i, c, s: spatial.nearest_below(i, strict=True),
    "crossed_by_lines": lambda i, c, s: spatial.crossed_by_lines(i, s.filter("orient = 'h'")),
    "cut_crossings": lambda i, c, s: spatial.cut_crossings(i, s),
    "nested_pairs": lambda i, c, s: spatial.nested_pairs(c),
    "deduplicated": lambda i, c, s: grouping.deduplicated(i),
    "chained": lambda i, c, s: grouping.chained(i),
    "chained_strict": lambda i, c, s: grouping.chained(i, strict=True),
    "merged_lines": lambda i, c, s: grouping.merged_lines(i),
    "anchored_lines": lambda i, c, s: grouping.anchored_lines(s),
    "split_across_cells": lambda i, c, s: grouping.split_across_cells(i, s.filter("orient = 'h'")),
    "merged_items": lambda i, c, s: grouping.merged_items(i, c),
    "merged_items_enclosed": lambda i, c, s: grouping.merged_items(i, c.filter("x1 < 300"), segments=s, page_w=1000, page_h=800),
    "axis_cuts": lambda i, c, s: tiling.axis_cuts(i.filter("item_id < 5"), i.select("page_id").distinct(), "x", 1000, 300),
    "smart_tiles": lambda i, c, s: tiling.smart_tiles(i.filter("item_id < 5"), i.select("page_id").distinct(), 1600, 1400, 640),
    "clusters": lambda i, c, s: sequences.clusters(i, ["page_id"], "x1", 25),
    "coordinate_runs": lambda i, c, s: sequences.coordinate_runs(i, ["page_id"], "x1"),
    "table_region": lambda i, c, s: aggregates.table_region(c, 1000, 800),
    "named_cells": lambda i, c, s: aggregates.named_cells(c.dropDuplicates(["page_id", "x1", "y1", "x2", "y2"])),
    "cell_report": lambda i, c, s: aggregates.cell_report(c, assigned(i, c)),
    "cell_layout": lambda i, c, s: fitting.cell_layout(assigned(i, c)),
    "fitted_lines": lambda i, c, s: fitting.fitted_lines(i),
    "text_gap_cells": lambda i, c, s: flows.text_gap_cells(i, c, 1000, 800),
    "cell_cascade": lambda i, c, s: flows.cell_cascade({"M": c.filter("morph"), "A": c.filter("NOT morph")}, i),
    "dispatched_cells": lambda i, c, s: flows.dispatched_cells(c.filter("morph AND x1 > 100"), c),
}


def assigned(i, c):
    b = spatial.best_cell(i, c).drop("overlap").withColumnsRenamed({"page_id": "__p", "item_id": "__i"})
    return i.join(b, (F.col("page_id") == F.col("__p")) & (F.col("item_id") == F.col("__i"))).drop("__p", "__i")


def frames(spark, parts):
    items, cells, lines = ([row for p in parts for row in p[k]] for k in range(3))
    seg = spark.createDataFrame(lines, "page_id bigint, orient string, pos int, lo int, hi int")
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(cells, CELL), seg


def rows(df):
    names = sorted(df.columns)
    return Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_pages_with_equal_item_numbers(spark, name):
    one, two = page(1, 5), page(2, 6)
    run = OPERATORS[name]
    alone = rows(run(*frames(spark, [one]))) + rows(run(*frames(spark, [two])))
    assert rows(run(*frames(spark, [one, two]))) == alone and alone


def test_chains_by_plain_code(spark):
    """From the top down, each chain takes the nearest aligned free line under its last one."""
    pages = defaultdict(list)
    for r in v.items(spark, SF).collect():
        pages[r.page_id].append(r)
    want = {}
    for p, items in pages.items():
        free = sorted(items, key=lambda r: (r.y1, r.item_id))
        while free:
            last = first = free.pop(0)
            k = 0
            while last is not None:
                want[p, last.item_id] = (first.item_id, k)
                near = []
                for o in free:
                    gap = o.y1 - last.y2
                    wide = max(last.x2 - last.x1, o.x2 - o.x1, 1)
                    aligned = abs(last.x1 - o.x1) < 60 or abs(last.x2 - o.x2) < 60 or abs(last.x1 + last.x2 - o.x1 - o.x2) < 160 or (min(last.x2, o.x2) - max(last.x1, o.x1)) / wide > 0.4
                    if 0 <= gap <= 1.25 * (last.y2 - last.y1 + o.y2 - o.y1) and aligned:
                        near.append((gap, o.y1, o.item_id, o))
                last = min(near, key=lambda x: x[:3])[3] if near else None
                if last is not None:
                    free.remove(last)
                    k += 1
    assert {(r.page_id, r.item_id): (r.chain, r.place) for r in grouping.chained(v.items(spark, SF)).collect()} == want


def test_turned_items_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, "a", 10, 0, 90, 20, 0.9, 0.0, "x", 9.0), (1, 1, "b", 10, 24, 90, 44, 0.9, 90.0, "x", 9.0), (1, 2, "c", 10, 24, 90, 46, 0.9, 1.0, "x", 9.0)], ITEM)
    got = {r.text: r.angle for r in grouping.merged_lines(df).collect()}
    assert got == {"a\nc": 0.0, "b": 90.0}
    terms = spark.createDataFrame([(0, "b", "B")], "ord int, cn string, en string")
    placed = flows.unified_flow(df, terms, spark.createDataFrame([], "text string, translated string"), lambda x: [t.upper() for t in x], script=None).collect()
    assert sorted(r.text for r in placed) == ["A", "B", "C"] and len({r.item_id for r in placed}) == 3


def test_items_of_cells_lines_and_text(spark):
    """One item over two cells is cut; one that lines enclose is taken into no paragraph."""
    cells = spark.createDataFrame([(1, 0, 0, 100, 50, False, 4), (1, 0, 50, 100, 100, False, 4)], CELL)
    rows_ = [(0, "up\ndown", 10, 10, 90, 90), (1, "first", 300, 200, 400, 220), (2, "second", 300, 225, 400, 245), (3, "boxed", 300, 250, 400, 270)]
    df = spark.createDataFrame([(1, k, t, *b, 0.9, 0.0, "x", 9.0) for k, t, *b in rows_], ITEM)
    lines = spark.createDataFrame([(1, "h", 248, 290, 410), (1, "h", 272, 290, 410), (1, "v", 290, 248, 272), (1, "v", 410, 248, 272)], "page_id bigint, orient string, pos int, lo int, hi int")
    text = lambda **kw: sorted((r.text, r.kind) for r in grouping.merged_items(df, cells, **kw).collect())
    assert text() == [("down", "cell"), ("first\nsecond\nboxed", "text"), ("up", "cell")]
    assert text(segments=lines.filter("pos > 240"), page_w=500, page_h=300)[0] == ("boxed", "text")


def test_recognition_chain_by_plain_code(spark):
    """Tiles overlap, so items near their borders are read twice by each engine; one reading of each stays."""
    got = catalog.QUERIES["recognition_chain"](spark, SF).collect()
    raw = defaultdict(list)
    for r in v.items(spark, SF).collect():
        raw[r.page_id].append(r)
    assert len({(r.page_id, r.item_id) for r in got}) == len(got)
    for r in got:
        assert any(r.text in (o.text, o.text[:-1]) and abs(r.x1 - o.x1) <= 1 and (r.y1, r.x2, r.y2) == (o.y1, o.x2, o.y2) for o in raw[r.page_id])
    # an item that some tile holds whole and that is sure enough is there, or one that it is a near-duplicate of
    xs, ys = [0, 500], [0, 200]
    for p, items in raw.items():
        mine = [r for r in got if r.page_id == p]
        for o in items:
            whole = any(x <= o.x1 and o.x2 <= x + 700 for x in xs) and any(y <= o.y1 and o.y2 <= y + 700 for y in ys)
            if whole and o.confidence >= DEFAULT.min_confidence:
                assert any(min(o.x2, r.x2) > max(o.x1, r.x1) and min(o.y2, r.y2) > max(o.y1, r.y1) for r in mine)


def test_an_engine_that_fails_leaves_the_other(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 50, 50, bytearray(b"x"))], "page_id bigint, x int, y int, w int, h int, pixels binary")

    def broken():
        raise RuntimeError("not there")

    def failing():
        def read(pixels, w, h):
            raise ValueError("no")

        return read

    good = lambda: lambda pixels, w, h: [("abc", -5, 0, 20, 10, 0.0, 0.9), ("abc", 0, 0, 20, 10, 0.0, 0.1)]
    got = readers.recognised_tiles(tiles, {"a": broken, "b": failing, "c": good}, 40, 40).collect()
    assert [(r.item_id, r.text, r.x1, r.source) for r in got] == [(1, "abc", 0, "c")]


def test_corners_and_white_of_closed_cells(spark):
    image = np.full((120, 120), 255, np.uint8)
    image[20, 20:101] = image[80, 20:101] = image[20:81, 20] = image[20:81, 100] = 0
    dark = image.copy()
    dark[25:75, 25:95] = 0
    rasters = spark.createDataFrame([(1, 120, 120, bytearray(image.tobytes())), (2, 120, 120, bytearray(dark.tobytes()))], "page_id bigint, width int, height int, pixels binary")
    cells = spark.createDataFrame([(p, *b, False, s) for p in (1, 2, 3) for b in ((20, 20, 100, 80), (40, 40, 90, 70)) for s in (3, 4)], CELL)
    got = raster.closed_cells(cells, rasters).collect()
    assert sorted((r.page_id, r.x1, r.sides) for r in got) == [(1, 20, 3), (1, 20, 4)]
    assert kernels.dark_corners(image, (20, 20, 100, 80), 6) == 4 and kernels.dark_corners(image, (40, 40, 90, 70), 6) == 0


def test_layers_of_one_and_several_lines(spark):
    df = spark.createDataFrame([(1, 0, "ab", 100, 40), (1, 1, "a long text of many words that does not fit at all", 30, 12), (1, 2, None, 10, 10)], "page_id bigint, item_id bigint, text string, layer_w int, layer_h int")
    got = defaultdict(list)
    for r in fitting.layer_texts(df).orderBy("item_id", "line_no").collect():
        got[r.item_id].append(r)
    (one,) = got[0]
    assert one.y == int((40 - 1.374 * one.font_size) / 2) and not one.overflow  # in the middle
    assert got[1][0].y == 0 and got[1][0].overflow and all(r.y <= 12 for r in got[1])  # from the top, clipped


def test_layers_of_quads(spark):
    quad = [(0, 30), (40, 0), (46, 8), (6, 38)]  # 50 by 10, turned
    df = spark.createDataFrame([(1, 0, 0, 0, 46, 38, quad)], "page_id bigint, item_id bigint, x1 int, y1 int, x2 int, y2 int, quad array<struct<x:int,y:int>>")
    r = fitting.quad_layers(df).first()
    assert (r.layer_w, r.layer_h) == (46, 10) and round(r.angle, 2) == -36.87  # no longer than the box's longer side
    assert (r.left, r.top) == (int((46 - 43) / 2), int((38 - 36) / 2))
    inside = fitting.in_quad(F.col("px"), F.col("py"))
    pts = spark.createDataFrame([(23, 19), (0, 0), (46, 38), (0, 30)], "px int, py int").crossJoin(df)
    assert [x[0] for x in pts.select(inside).collect()] == [True, False, False, True]


def test_largest_fitting_size(spark):
    """No larger size would do, by an independent wrap of single words."""
    items = spark.createDataFrame([(1, k, "w" * n, 0, 0, w, h, 0.9, 0.0, "x", 40.0) for k, (n, w, h) in enumerate([(4, 100, 30), (9, 200, 200), (3, 500, 10), (6, 60, 14)])], ITEM)
    got = {r.item_id: r for r in fitting.fitted_lines(items).collect()}
    for r in items.collect():
        sizes = [s for s in range(40, 4, -1) if len(r.text) * 0.5 * s <= r.x2 and 1.374 * s <= r.y2]
        assert got[r.item_id].font_size == sizes[0]


def test_pages_in_many_batches(spark):
    """A page that goes over many batches is put together once, and rows without a page are left out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(k % 3 if k % 50 else None, k) for k in range(400)], "page_id bigint, n int")
        from folioframe.operators.paging import by_page

        got = {r.page_id: r.n for r in by_page(df, lambda rows: [(rows[0].page_id, len(rows))], "page_id bigint, n int").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {p: sum(1 for k in range(400) if k % 50 and k % 3 == p) for p in range(3)}

"""Pages that are looked at twice are made and handed over once, and their tiles are those of the joins."""

import numpy as np
from pyspark.sql import functions as F

from folioframe.functions import raster as kernels
from folioframe.functions.greedy import page_tiles
from folioframe.operators import tiling
from folioframe.plans import catalog
from folioframe.sources import readers


def test_pages_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def draw(frames):
        import pandas as pd

        for f in frames:
            for p in f.page_id:
                made.add(1)
                image = np.full((200, 300), 255, np.uint8)
                image[20:40, 30:50] = image[150:170, 250:270] = 0
                yield pd.DataFrame([(p, 300, 200, image.tobytes())], columns=["page_id", "width", "height", "pixels"])

    rasters = spark.range(6).select(F.col("id").alias("page_id")).mapInPandas(draw, "page_id bigint, width int, height int, pixels binary")
    got = readers.coarse_to_fine(rasters, catalog.box_engine, 120, 100).collect()
    assert sorted((r.page_id, r.x1, r.y1, r.x2, r.y2) for r in got) == [(p, *b) for p in range(6) for b in ((30, 20, 50, 40), (250, 150, 270, 170))]
    assert made.value == 6


def test_tiles_of_a_page_are_those_of_the_joins(spark):
    boxes = [(1, 0, 0, 90, 30), (1, 300, 200, 420, 260), (1, 700, 20, 760, 300), (2, 10, 10, 50, 50), (4, 0, 0, 900, 700), (5, 100, 100, 130, 400)]
    sizes = [(1, 900, 700), (2, 200, 100), (3, 950, 330), (4, 900, 700), (5, 260, 610), (6, 1, 800)]
    items = spark.createDataFrame(boxes, "page_id bigint, x1 int, y1 int, x2 int, y2 int")
    pages = spark.createDataFrame(sizes, "page_id bigint, page_w int, page_h int")
    want = sorted(tuple(r) for r in tiling.smart_tiles(items, pages, None, None, 240, 250).collect())
    got = [(p, *t) for p, w, h in sizes for t in page_tiles([b[1:] for b in boxes if b[0] == p], w, h, 240, tiling.CUT_MARGIN, 80, 250)]
    assert sorted(got) == want and len({r[0] for r in want}) == 6


def test_components_that_meet_again_below():
    """Arms that touch across a corner, join several rows further down, and lie beside a region of their own."""
    mask = np.array([[c == "#" for c in row] for row in ("#.#.#..#", "#..#...#", ".##..#.#", "......#.", "##......", "..#.##.#")])
    found = kernels.components(mask)
    assert found == [((0, 0, 5, 3), 7), ((5, 0, 8, 4), 5), ((0, 4, 3, 6), 3), ((4, 5, 6, 6), 2), ((7, 5, 8, 6), 1)]

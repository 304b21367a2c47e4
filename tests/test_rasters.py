"""What is held of raster pages at once, and equal images."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF

from folioframe.operators import raster
from folioframe.plans import catalog
from folioframe.plans import views as v

RASTER = "page_id bigint, width int, height int, pixels binary"


@pytest.mark.parametrize("name", ["_rasters", "_drawn_items"])
def test_a_batch_of_page_numbers_is_drawn_in_parts(spark, monkeypatch, name):
    drawing = []
    monkeypatch.setattr(type(v.page_ids(spark, SF)), "mapInPandas", lambda df, f, schema, **kw: drawing.append(f))
    getattr(catalog, name)(spark, SF)
    pages = pd.DataFrame({"page_id": range(1000), "boxes": [[{"x1": 1, "y1": 2, "x2": 9, "y2": 9}]] * 1000})
    frames = list(drawing[0](iter([pages])))
    assert max(f.pixels.map(len).sum() for f in frames) <= raster.BATCH_BYTES
    assert [p for f in frames for p in f.page_id] == list(range(1000))


def test_equal_images_are_looked_at_once(spark):
    seen = []

    def kernel(image):
        seen.append(image.shape)
        return [(int(image[0, 0]),)]

    look = raster.once_an_image(kernel, most=4)
    a, b, c = bytes([1] * 6), bytes([2] * 6), bytes([3] * 6)
    assert [look(p, w, 6 // w) for p, w in ((a, 2), (a, 2), (b, 2), (a, 3), (a, 2))] == [[(1,)], [(1,)], [(2,)], [(1,)], [(1,)]]
    assert len(seen) == 4  # the memory holds two images of one row: it was emptied before the third, so the first is looked at anew
    look(c, 2, 3)
    assert len(seen) == 5


def test_of_rasters_of_one_size_the_last_by_its_pixels_counts(spark):
    """Packed pixels are in another order than pixels."""
    flat = np.full((40, 40), 7, np.uint8)
    noisy = np.random.default_rng(1).integers(0, 6, (40, 40)).astype(np.uint8)
    high = np.full((40, 40), 7, np.uint8)
    high[39, 39] = 9
    rasters = spark.createDataFrame([(1, 40, 40, bytearray(i.tobytes())) for i in (noisy, high, flat, high)], RASTER)
    assert [bytes(r.pixels) for r in raster.one_a_page(rasters).collect()] == [high.tobytes()]
    boxes = spark.createDataFrame([(1, 2**60 + 1, 36, 36, 39, 39), (2, 5, 1, 1, 9, 9)], "page_id bigint, item_id bigint, x1 int, y1 int, x2 int, y2 int")
    assert [(r.item_id, r.mean_level) for r in raster.measured(boxes, rasters).collect()] == [(2**60 + 1, high[34:, 34:].mean())]


@pytest.mark.parametrize("name", ["barred_chain", "raster_levels", "closed_cells"])
def test_no_step_on_pixels_sorts_or_deals_whole_images(spark, name):
    """Between the drawing and the look at a page only packed pixels are dealt."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(struct(width" not in plan and "packed" in plan


def test_pages_that_are_looked_at_twice_come_in_bounded_batches(spark):
    """No other raster query need have run before; tiles meet packed pixels."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(1 << 30))
    try:
        catalog.QUERIES["coarse_to_fine"](spark, SF)
        assert int(spark.conf.get(key)) <= raster.BATCH_BYTES
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)

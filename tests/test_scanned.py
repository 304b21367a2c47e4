"""The three detectors of scanned pages see each page once and find what each finds alone."""

import numpy as np
from test_detect import RASTER, page
from test_stages import counted

from folioframe.operators import items, raster
from folioframe.plans import flows


def drawn():
    image = np.full((500, 420), 255, np.uint8)
    image[20:461:110, 20:401] = image[20:461, 20:401:95] = 0
    frame = np.full((200, 300), 255, np.uint8)
    frame[20:22, 20:150] = frame[98:100, 20:150] = frame[20:100, 20:22] = frame[20:100, 148:150] = 60
    return [page(image), page(frame, 2), page(image, 3), page(frame, None), (4, None, None, None)]


def test_pages_are_made_once_for_all_detectors(spark):
    rasters, seen = counted(spark.createDataFrame(drawn(), RASTER))
    texts = spark.createDataFrame([(p, 30 + 95 * i, 30 + 110 * j, 90 + 95 * i, 60 + 110 * j) for p in (1, 3) for i in range(4) for j in range(4)], "page_id bigint, x1 int, y1 int, x2 int, y2 int")
    found = flows.scanned_cells(rasters, texts).collect()
    assert sorted({r.page_id for r in found}) == [1, 3] and len(found) == 32
    assert seen.value == 5


def test_all_detectors_find_what_each_finds(spark):
    rasters = spark.createDataFrame(drawn(), RASTER)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    alone = raster.detected_cells(rasters), raster.detected_contours(rasters), raster.detected_segments(rasters)
    for one, own in zip(raster.detected_by_all(rasters), alone, strict=True):
        assert one.columns == own.columns and one.dtypes == own.dtypes
        assert rows(one) == rows(own) and rows(own)
    assert items.contour_gate(alone[1]).count()


def test_a_worker_keeps_what_was_found_for_its_next_tasks():
    asked = []
    kernel = lambda image: asked.append(1) or [(int(image.sum()),)]
    looks = [raster.once_a_worker(kernel, ("sum", k)) for k in (1, 1, 2)]
    assert [look(b"\x01\x02", 2, 1) for look in looks] == [[(3,)]] * 3 and len(asked) == 2
    for k in range(20):
        raster.once_a_worker(kernel, ("more", k))
    assert len(raster._looks) <= 8

"""Detectors: plain loops on small images, drawn lines of known ends, and the operators on rasters."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.functions import detect
from folioframe.functions import raster as plain
from folioframe.operators import items
from folioframe.operators import raster
from folioframe.plans import flows

RASTER = "page_id bigint, width int, height int, pixels binary"


def page(image, page_id=1):
    return (page_id, image.shape[1], image.shape[0], bytearray(image.tobytes()))


def flood(mask, diagonal=True):
    """Components as sets of (y, x), by walking from pixel to pixel."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a or not b)]
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        open_pixels, found = [min(left)], set()
        while open_pixels:
            p = open_pixels.pop()
            if p in left:
                left.discard(p)
                found.add(p)
                open_pixels += [(p[0] + a, p[1] + b) for a, b in steps if (p[0] + a, p[1] + b) in left]
        out.append(found)
    return out


masks = st.integers(0, 10_000).map(lambda s: np.random.default_rng(s).random((1 + s % 17, 1 + s % 23)) < (0.2 + s % 7 / 10))


@pytest.mark.parametrize("block", [3, 7, 21])
def test_local_means(block):
    image = np.random.default_rng(block).integers(0, 256, (23, 31), dtype=np.uint8)
    r = block // 2
    wide = np.pad(image.astype(float), r, mode="edge")
    spread = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    tap = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * spread**2))
    weights = np.outer(tap, tap) / np.outer(tap, tap).sum()
    for gaussian, w in ((True, weights), (False, np.full((block, block), 1 / block**2))):
        want = [[(wide[y : y + block, x : x + block] * w).sum() for x in range(31)] for y in range(23)]
        assert np.allclose(plain.local_mean(image, block, gaussian), want)
    with pytest.raises(ValueError):
        plain.local_mean(image, 4)


def test_pale_lines_on_shaded_ground():
    """Thin lines 25 levels below a ground that runs from dark to light; the page's own threshold cannot part them."""
    ground = np.tile(np.linspace(90, 250, 300), (200, 1))
    for x in (40, 150, 260):
        ground[30:171, x] -= 25
    for y in (30, 100, 170):
        ground[y, 40:261] -= 25
    image = np.rint(ground).astype(np.uint8)
    lines = np.zeros(image.shape, bool)
    lines[30:171, [40, 150, 260]] = lines[[30, 100, 170], 40:261] = True
    found = plain.locally_dark(image)
    assert found[lines].all() and not found[~plain.dilated(lines)].any()
    # The left half is dark by the page's own threshold, whose lines in the right half are none.
    assert [b[2] - b[0] for b in plain.cells_by_components(image) if 60 <= b[2] - b[0] <= 120] == [105, 105]
    assert not (image <= plain.otsu(image))[:, 200:].any()


@settings(max_examples=150, deadline=None)
@given(masks, st.booleans())
def test_run_labels_are_components(mask, diagonal):
    row, start, end, label = detect.run_labels(mask, diagonal)
    got = {}
    for r, a, b, k in zip(row.tolist(), start.tolist(), end.tolist(), label.tolist(), strict=True):
        got.setdefault(k, set()).update((r, x) for x in range(a, b))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, flood(mask, diagonal)))
    assert (detect.painted(mask.shape, row, start, end) == mask).all()


def test_long_winding_components_are_one():
    mask = np.zeros((401, 401), bool)
    mask[::4] = True
    mask[:, 0] = mask[:, -1] = False
    for k in range(0, 400, 4):
        mask[k : k + 5, 1 if k % 8 else 399] = True
    assert len(set(detect.run_labels(mask)[3].tolist())) == 1


def test_edges_of_a_box():
    image = np.zeros((60, 80), np.uint8)
    image[20:40, 20:60] = 255
    found = detect.edges(image)
    ys, xs = np.nonzero(found)
    assert ys.min() in (19, 20) and ys.max() in (39, 40) and xs.min() in (19, 20) and xs.max() in (59, 60)
    assert found.sum() >= 2 * (18 + 38) and not found[22:38, 22:58].any()
    weak = np.zeros((40, 40), np.uint8)
    weak[:, 20:] = 8  # gradient 32: over the low limit, and never over the high one
    assert not detect.edges(weak).any()
    weak[5, 20:] = 60  # one strong place keeps the ridge that hangs together with it
    assert detect.edges(weak)[10:30].sum() >= 15


@pytest.mark.parametrize("ends", [(10, 20, 180, 20), (30, 5, 30, 140), (10, 30, 170, 60), (60, 10, 90, 145), (20, 20, 120, 120)])
def test_segments_of_known_ends(ends):
    """One drawn line with breaks of up to ten pixels is one segment with ends within two pixels."""
    x1, y1, x2, y2 = ends
    n = max(abs(x2 - x1), abs(y2 - y1)) + 1
    xs, ys = np.rint(np.linspace(x1, x2, n)).astype(int), np.rint(np.linspace(y1, y2, n)).astype(int)
    mask = np.zeros((150, 200), bool)
    mask[ys, xs] = True
    mask[ys[40:50], xs[40:50]] = False
    found = detect.line_segments(mask, seed=7)
    assert len(found) >= 1 and found == detect.line_segments(mask, seed=7)
    a, b, c, d = max(found, key=lambda s: abs(s[2] - s[0]) + abs(s[3] - s[1]))
    (a, b), (c, d) = sorted([(a, b), (c, d)])
    (x1, y1), (x2, y2) = sorted([(x1, y1), (x2, y2)])
    assert max(abs(a - x1), abs(b - y1), abs(c - x2), abs(d - y2)) <= 2


def test_segments_stop_at_wide_breaks_and_short_lines_are_none():
    mask = np.zeros((100, 200), bool)
    mask[50, 10:80] = mask[50, 110:190] = True
    mask[20, 10:20] = True
    found = sorted(tuple(sorted((s[0], s[2]))) for s in detect.line_segments(mask))
    assert found == [(10, 79), (110, 189)]
    assert detect.line_segments(np.zeros((5, 5), bool)) == []


@settings(max_examples=150, deadline=None)
@given(masks)
def test_contours_are_those_of_flood_fill(mask):
    """Boxes of components that border on open ground, from a flood fill of both."""
    wide = np.pad(mask, 1)
    ground = next(c for c in flood(~wide, False) if (0, 0) in c)
    want = []
    for c in flood(wide):
        y, x = min(c)
        if (y, x - 1) in ground:
            want.append((min(q for _, q in c) - 1, y - 1, max(q for _, q in c), max(p for p, _ in c)))
    got = detect.outer_contours(mask)
    assert sorted(b for b, _, _ in got) == sorted(want)
    for box, area, corners in got:
        assert 0 <= area <= (box[2] - box[0] - 1) * (box[3] - box[1] - 1) and corners >= 1


def test_contours_of_shapes():
    mask = np.zeros((120, 200), bool)
    mask[10:61, 10:101] = True
    mask[20:51, 20:91] = False
    mask[30:41, 40:71] = True  # in the hole of the frame: no contour of its own
    y, x = np.mgrid[0:120, 0:200]
    mask |= (x >= 120) & (y >= 20) & (x - 120 <= y - 20) & (y <= 80)  # a triangle
    found = {b: (area, corners) for b, area, corners in detect.outer_contours(mask)}
    assert found == {(10, 10, 101, 61): (90 * 50, 4), (120, 20, 181, 81): (60 * 60 / 2, 3)}
    assert detect.outer_contours(mask, min_w=70) == [((10, 10, 101, 61), 4500.0, 4)]
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert detect.outer_contours(one) == [((1, 1, 2, 2), 0.0, 1)]


def test_corners_of_a_line():
    line = [(x, 0) for x in range(10)] + [(9, y) for y in range(1, 6)] + [(x, 5) for x in range(8, -1, -1)] + [(0, y) for y in range(4, 0, -1)]
    assert detect.simplified(line, 0.5) == [(0, 0), (9, 0), (9, 5), (0, 5)] and detect.polygon_area(line) == 45
    noisy = [(x, y + (x % 2) * 0.4) for x, y in line]
    assert len(detect.simplified(noisy, 1.0)) == 4 and detect.simplified([(1, 1)], 1) == [(1, 1)]


@settings(max_examples=60, deadline=None)
@given(masks)
def test_closing_fills_and_keeps(mask):
    made = detect.closed(mask)
    assert made[mask].all() and (detect.closed(made) == made).all()
    wide = np.pad(mask, 2)
    grown = plain.dilated(wide)
    want = np.array([[grown[y : y + 3, x : x + 3].all() for x in range(1, 1 + mask.shape[1])] for y in range(1, 1 + mask.shape[0])])
    assert (made == want).all()


def table_page(shade=255, pen=0):
    image = np.full((260, 420), shade, np.uint8)
    image[20:241:55, 20:401] = pen
    image[20:241, 20:401:95] = pen
    return image


def test_operators_find_a_drawn_table(spark):
    rasters = spark.createDataFrame([page(table_page()), page(table_page(230, 200), 2), page(np.full((50, 60), 255, np.uint8), 3), (4, None, None, None)], RASTER)
    cells = raster.detected_cells(rasters).filter("x2 - x1 < 200 AND y2 - y1 < 100").collect()
    assert {p: sum(c.page_id == p for c in cells) for p in (1, 2, 3)} == {1: 16, 2: 16, 3: 0}

    segments = raster.detected_segments(rasters)
    kinds = items.segment_kind(segments).collect()
    for p in (1, 2):
        for orient, places in (("h", range(20, 241, 55)), ("v", range(20, 401, 95))):
            for at in places:
                assert any(k.page_id == p and k.orient == orient and abs(k.pos - at) <= 2 and k.hi - k.lo >= 200 for k in kinds), (p, orient, at)
    assert not [k for k in kinds if k.page_id > 2]
    numbers = [(r.page_id, r.item_id) for r in segments.collect()]
    assert len(set(numbers)) == len(numbers)

    grid = {(r.page_id, *(round((r[c] - o) / s) for c, o, s in (("x1", 20, 95), ("y1", 20, 55), ("x2", 20, 95), ("y2", 20, 55)))) for r in flows.intersection_grid(segments).collect()}
    assert grid >= {(p, i, j, i + 1, j + 1) for p in (1, 2) for i in range(4) for j in range(4)}


def test_contour_operator(spark):
    image = np.full((200, 300), 255, np.uint8)
    image[20:22, 20:150] = image[98:100, 20:150] = image[20:100, 20:22] = image[20:100, 148:150] = 60  # a frame
    image[120:180, 20:100] = 60  # a filled box: dark inside
    image[10:14, 200:260] = 0  # too flat
    rasters = spark.createDataFrame([page(image), page(image, None)], RASTER)
    found = raster.detected_contours(rasters).collect()
    boxes = {(r.x1, r.y1, r.x2, r.y2) for r in found if r.page_id == 1}
    assert any(abs(a - 20) <= 1 and abs(b - 20) <= 1 and abs(c - 150) <= 1 and abs(d - 100) <= 1 for a, b, c, d in boxes)
    kept = items.contour_gate(raster.detected_contours(rasters)).collect()
    assert {(r.page_id, r.corners) for r in kept} == {(1, 4), (None, 4)} and all(r.x1 <= 20 and r.y1 <= 20 and r.y2 <= 101 for r in kept)


def test_cells_of_scanned_pages(spark):
    """A table higher than a cell can be, so that its outer contour is none."""
    image = np.full((500, 420), 255, np.uint8)
    image[20:461:110, 20:401] = 0
    image[20:461, 20:401:95] = 0
    rasters = spark.createDataFrame([page(image), page(image, 5)], RASTER)
    texts = spark.createDataFrame([(1, 4 * i + j, "t", 30 + 95 * i, 30 + 110 * j, 90 + 95 * i, 60 + 110 * j) for i in range(4) for j in range(4)], "page_id bigint, item_id bigint, text string, x1 int, y1 int, x2 int, y2 int")
    found = flows.scanned_cells(rasters, texts).collect()
    # Grid cells go along the lines, so those of the enclosed regions lie in them; page 5 has no texts and keeps none.
    assert {r.page_id for r in found} == {1} and len(found) == 16
    assert {(round((r.x1 - 20) / 95), round((r.y1 - 20) / 110)) for r in found} == {(i, j) for i in range(4) for j in range(4)}
    assert sorted(r.cell_no for r in found) == list(range(1, 17))
    assert flows.scanned_cells(rasters.limit(0), texts).count() == 0


def test_of_several_rasters_of_a_page_the_widest_counts(spark):
    small, wide = np.zeros((40, 40), np.uint8), np.full((40, 90), 200, np.uint8)
    rows = [page(small), page(wide), page(small), (2, None, None, None), page(small, None)]
    boxes = spark.createDataFrame([(1, 1, 10, 10, 30, 30), (2, 2, 10, 10, 30, 30)], "page_id bigint, item_id bigint, x1 int, y1 int, x2 int, y2 int")
    for r in (rows, rows[::-1]):
        rasters = spark.createDataFrame(r, RASTER)
        assert [(x.page_id, x.mean_level) for x in raster.measured(boxes, rasters).collect()] == [(1, 200.0)]
        assert sorted((x.page_id, x.width) for x in raster.one_a_page(rasters).filter("page_id IS NOT NULL").collect()) == [(1, 90)]

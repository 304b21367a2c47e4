"""Queries without comparison SQL take every row of their tables: plain Python over whole pages gives the same."""

from collections import defaultdict
from itertools import pairwise, product
from math import floor
from statistics import median

import numpy as np
from conftest import SF

from folioframe.functions.greedy import best_splits, deduplicated
from folioframe.plans import catalog
from folioframe.plans import views as v


def by_page(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page_id].append(r)
    return out


def cuts(items, lo, hi, total, target):
    covered = [False] * total
    for i in items:
        a, b = max(0, i[lo] - 30), min(total, i[hi] + 30)
        covered[a:b] = [True] * max(0, b - a)
    edges = [0, *[k for k in range(1, total) if covered[k] != covered[k - 1]], total]
    return best_splits([(a, b) for a, b in pairwise(edges) if not covered[a] and b - a >= 80], total, target)


def test_smart_cuts_of_all_items(spark):
    want = {(p, "v", c) for p, items in by_page(v.items(spark, SF)).items() for c in cuts(items, "x1", "x2", 1200, 400)}
    assert {tuple(r) for r in catalog.QUERIES["smart_cuts"](spark, SF).collect()} == want and want


def test_smart_tiles_of_all_items(spark):
    want = set()
    for p, items in by_page(v.items(spark, SF)).items():
        xs, ys = ([0, *cuts(items, f"{c}1", f"{c}2", total, 640), total] for c, total in (("x", 1600), ("y", 1400)))
        want |= {(p, a, c, b - a, d - c) for (a, b), (c, d) in product(pairwise(xs), pairwise(ys))}
    assert {tuple(r) for r in catalog.QUERIES["smart_tiles"](spark, SF).collect()} == want and want


def test_text_gap_cells_of_all_items(spark):
    want = set()
    for p, items in by_page(v.items(spark, SF)).items():
        inside = [i for i in items if i.x2 <= 1152 and i.y2 <= 864]  # the cells' region, 960 by 720, widened by a fifth
        lines = []
        for lo, hi, tolerance in (("x1", "x2", 25), ("y1", "y2", 20)):
            found = set()
            for c in (lo, hi):
                runs = []
                for x in sorted(i[c] for i in inside):
                    if runs and x - runs[-1][-1] <= tolerance:
                        runs[-1].append(x)
                    else:
                        runs.append([x])
                found |= {floor(median(r)) for r in runs}
            lines.append(sorted(found))
        want |= {(p, a, c, b, d) for (a, b), (c, d) in product(*map(pairwise, lines)) if 20 <= b - a <= 1200 and 20 <= d - c <= 400}
    assert {tuple(r) for r in catalog.QUERIES["text_gap_cells"](spark, SF).collect()} == want and want


def test_cell_cascade_of_all_items(spark):
    items, want = by_page(v.items(spark, SF)), set()
    holds = lambda a, b: a != b and a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def near(c, i):
        x, y = (i.x1 + i.x2) / 2, (i.y1 + i.y2) / 2
        w, h = min(c[2], i.x2) - max(c[0], i.x1), min(c[3], i.y2) - max(c[1], i.y1)
        shares = w > 0 and h > 0 and w * h > 0.3 * (i.x2 - i.x1) * (i.y2 - i.y1)
        return (c[0] <= x <= c[2] and c[1] <= y <= c[3]) or shares or ((c[0] + c[2]) / 2 - x) ** 2 + ((c[1] + c[3]) / 2 - y) ** 2 <= 2500

    def beside(a, b):
        one = lambda p, q: abs(a[p] - b[p]) <= 8 and abs(a[p + 2] - b[p + 2]) <= 8 and min(abs(a[q + 2] - b[q]), abs(b[q + 2] - a[q])) <= 10
        return a != b and (one(1, 0) or one(0, 1))

    for p, cells in by_page(v.cells(spark, SF)).items():
        stages = defaultdict(set)
        for c in cells:
            stages[c.x1, c.y1, c.x2, c.y2] |= {"M" if c.morph else "A"} | ({"B"} if c.x1 < 300 else set())
        kept = [b for b, s in stages.items() if "M" in s or not any("M" in t and holds(o, b) for o, t in stages.items())]
        kept = [b for b in kept if not any(holds(o, b) and area(o) > area(b) for o in kept)]
        kept = [b for b in kept if any(near(b, i) for i in items[p])]
        kept = [b for b in kept if len(kept) == 1 or any(beside(b, o) for o in kept)]
        want |= {(p, *b, ",".join(sorted(stages[b])), n) for n, b in enumerate(sorted(kept, key=lambda b: (b[1], b[0], b[3], b[2])), 1)}
    got = {(r.page_id, r.x1, r.y1, r.x2, r.y2, r.stages, r.cell_no) for r in catalog.QUERIES["cell_cascade"](spark, SF).collect()}
    assert got == want and want


def test_coarse_to_fine_of_all_pages(spark):
    """The small image, its gaps, the tiles and what they hold, in plain code."""
    from folioframe.functions import raster

    want = set()
    for r in catalog._drawn_items(spark, SF).collect():
        image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
        engine, scale = catalog.box_engine(), 175 / max(image.shape)
        w, h = int(r.width * scale), int(r.height * scale)
        edges = lambda n, of: [k * of // n for k in range(n)] + [of]
        ys, xs = edges(h, r.height), edges(w, r.width)
        small = np.array([[np.rint(image[a:b, c:d].mean()) for c, d in pairwise(xs)] for a, b in pairwise(ys)]).astype(np.uint8)
        assert (raster.shrunk(image, w, h) == small).all()
        boxes = [[int(v / scale) for v in b] for _, *b, _, _ in engine(small)]
        cut = lambda lo, hi, total: [0, *cuts([{"lo": b[lo], "hi": b[hi]} for b in boxes], "lo", "hi", total, 120), total]
        tiles = list(product(pairwise(cut(0, 2, r.width)), pairwise(cut(1, 3, r.height)))) if boxes else []
        found = [(t, x1 + x, y1 + y, x2 + x, y2 + y, c) for (x, x_end), (y, y_end) in tiles for t, x1, y1, x2, y2, _, c in engine(image[y:y_end, x:x_end])]
        kept = deduplicated([{"id": k, "box": f[1:5], "text": f[0], "confidence": f[5]} for k, f in enumerate(sorted(found, key=lambda f: (f[2], f[1], f[4], f[3], f[0], f[5])))])
        want |= {(r.page_id, k["text"], *k["box"]) for k in kept}
    got = {(r.page_id, r.text, r.x1, r.y1, r.x2, r.y2) for r in catalog.QUERIES["coarse_to_fine"](spark, SF).collect()}
    assert got == want and len(want) > 200


def test_chains_on_rasters_of_all_pages(spark):
    from folioframe.functions import raster
    from folioframe.functions.greedy import chains

    images = {r.page_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in catalog._rasters(spark, SF).collect()}
    want = set()
    for p, items in by_page(v.items(spark, SF)).items():
        boxes = [{"id": i.item_id, "box": (i.x1 // 4, i.y1 // 4, i.x2 // 4, i.y2 // 4)} for i in items]
        barred = lambda a, b, image=images[p]: raster.bar_between(image, a["box"], b["box"])
        want |= {(p, x["id"], c[0]["id"], k) for c in chains(boxes, True, barred) for k, x in enumerate(c)}
    assert {tuple(r) for r in catalog.QUERIES["barred_chain"](spark, SF).select("page_id", "item_id", "chain", "place").collect()} == want
    assert len({w[2] for w in want}) < len(want)


def test_greedy_dedup_of_all_items(spark):
    want = set()
    for p, items in by_page(v.items(spark, SF)).items():
        kept = deduplicated([{"id": i.item_id, "box": (i.x1, i.y1, i.x2, i.y2), "text": i.text, "confidence": float(i.confidence)} for i in items])
        want |= {(p, k["id"]) for k in kept}
    got = [(r.page_id, r.item_id) for r in catalog.QUERIES["greedy_dedup"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_paragraph_chains_of_all_items(spark):
    """The nearest free line below among all lines of the page."""
    from folioframe.functions.greedy import follows

    want = set()
    for p, items in by_page(v.items(spark, SF)).items():
        lines = sorted(((i.x1, i.y1, i.x2, i.y2), i.item_id) for i in items)
        lines.sort(key=lambda x: (x[0][1], x[1]))
        free = [True] * len(lines)
        for start in range(len(lines)):
            at, place = start, 0
            while at is not None and free[at]:
                free[at] = False
                want.add((p, lines[at][1], lines[start][1], place))
                near = [(g, k) for k in range(len(lines)) if free[k] and (g := follows(lines[at][0], lines[k][0], False)) is not None]
                at, place = (min(near)[1] if near else None), place + 1
    got = {(r.page_id, r.item_id, r.chain, r.place) for r in catalog.QUERIES["paragraph_chain"](spark, SF).collect()}
    assert got == want and any(w[3] > 0 for w in want)


def test_raster_levels_of_all_items(spark):
    """Means and white shares pixel by pixel."""
    images = {r.page_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in catalog._rasters(spark, SF).collect()}
    want = {}
    for p, items in by_page(v.items(spark, SF)).items():
        for i in items:
            x1, y1, x2, y2 = (w // 4 for w in (i.x1, i.y1, i.x2, i.y2))
            around = [int(images[p][y, x]) for y in range(max(0, y1 - 2), min(240, y2 + 2)) for x in range(max(0, x1 - 2), min(320, x2 + 2))]
            inside = [int(images[p][y, x]) > 180 for y in range(y1 + 2, min(240, y2 - 2)) for x in range(x1 + 2, min(320, x2 - 2))]
            fits = x2 - x1 > 4 and y2 - y1 > 4
            want[p, i.item_id] = (round(sum(around) / len(around), 6), round(sum(inside) / len(inside), 6) if fits and inside else None)
    got = {(r.page_id, r.item_id): (round(r.mean_level, 6), None if r.white_ratio is None else round(r.white_ratio, 6)) for r in catalog.QUERIES["raster_levels"](spark, SF).collect()}
    assert got == want

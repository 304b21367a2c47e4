"""Order-dependent grouping. Kernels run on one page at a time: what they need is bounded by a page's items.

An item is known by its page and its number there: pages may use the same numbers. Rows without a page are in no group; a
null text is empty, a null confidence lowest, a null angle 0; ties go to the upper, then the left, then the smaller number;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import greedy, grid, raster
from ..params import DEFAULT, Params
from ..session import stored
from . import aggregates, sequences, spatial
from .paging import by_page, of_pages
from .raster import on_items

ITEM = "page_id bigint, item_id bigint, text string, x1 int, y1 int, x2 int, y2 int, confidence double, source string, angle double"
COLUMNS = [c.split()[0] for c in ITEM.split(", ")]
#: Pairs of boxes that a call keeps; with more it compares a page's items one by one.
MOST_PAIRS = 1 << 20


def upright(items: DataFrame) -> DataFrame:
    """The items with their angle, 0 where there is none."""
    return items.withColumn("angle", F.coalesce("angle", F.lit(0.0)) if "angle" in items.columns else F.lit(0.0))


def same_item() -> Column:
    return (F.col("page_id") == F.col("__p")) & (F.col("item_id") == F.col("__i"))


def rows_of(rows) -> list[dict]:
    """Rows of a page as the kernels take them."""
    return [
        {"id": r.item_id, "text": r.text or "", "box": (int(r.x1), int(r.y1), int(r.x2), int(r.y2)), "confidence": 0.0 if pd.isna(r.confidence) else float(r.confidence), "locked": bool(getattr(r, "locked", False))}
        for r in rows
    ]


def deduplicated(items: DataFrame, params: Params = DEFAULT, together: bool = False) -> DataFrame:
    """Items of each page without near-duplicates of overlapping tiles and engines.

    Pages come whole to one call: items are dealt once and meet no other rows. Boxes that agree are found in arrays; only items that
    have such a partner are compared by text, the others cannot match and pass by. Items are stored, unless those of a page lie
    ``together``, as a window over the pages leaves them: then they go on as they are.
    """
    items = upright(items).select(*COLUMNS)

    def kernel(rows: pa.Table) -> pa.Table:
        known = rows.select(["page_id", "item_id", *spatial.BOX])
        there = np.flatnonzero(np.logical_and.reduce([c.is_valid().to_numpy() for c in known.columns]))
        known = known.take(there)
        page, item, *box = (c.to_numpy() for c in known.columns)
        pairs, n_pairs = [], 0
        partner = np.zeros(len(page), bool)
        for a, b in greedy.agreeing(page, np.stack(box, 1), params.dedup_iou):
            differ = item[a] != item[b]
            partner[a[differ]] = partner[b[differ]] = True
            n_pairs += len(a)
            if n_pairs <= MOST_PAIRS:
                pairs.append((a, b))
        if not partner.any():
            return rows
        ids = set(zip(page[partner].tolist(), item[partner].tolist(), strict=True))
        if len(ids) < partner.sum() or len(ids) < len(set(zip(page.tolist(), item.tolist(), strict=True))):  # rows that repeat a number go with it
            partner = np.array([k in ids for k in zip(page.tolist(), item.tolist(), strict=True)])
        at = np.flatnonzero(partner)
        at = at[np.argsort(page[at], kind="stable")]
        place = np.full(len(page), -1)
        place[at] = np.arange(len(at))
        near: list[list[int]] | None = [[] for _ in at] if n_pairs <= MOST_PAIRS else None
        for a, b in pairs if near is not None else []:
            for x, y in zip(place[a].tolist(), place[b].tolist(), strict=True):
                if x >= 0 and y >= 0:
                    near[x].append(y)
                    near[y].append(x)
        own = rows.select(COLUMNS).take(there[at]).to_pandas()
        ends = [*np.flatnonzero(np.append(True, np.diff(page[at]) != 0)).tolist(), len(at)]
        stay = np.ones(len(rows), bool)
        dicts = rows_of(own.itertuples(index=False))
        for lo, hi in pairwise(ends):
            links = None if near is None else [[j - lo for j in x] for x in near[lo:hi]]
            kept = {x["id"] for x in greedy.deduplicated(dicts[lo:hi], params.dedup_iou, params.dedup_ratio, links)}
            for k in range(lo, hi):
                stay[there[at[k]]] = dicts[k]["id"] in kept
        return rows.filter(pa.array(stay))

    return of_pages(items if together else stored(items), kernel, together)


def chained(items: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, item_id, chain (the first item's id) and place of every item; a column ``locked`` keeps items alone."""
    df = items if "locked" in items.columns else items.withColumn("locked", F.lit(False))

    def kernel(rows: list) -> list[tuple]:
        return [(rows[0].page_id, x["id"], c[0]["id"], k) for c in greedy.chains(rows_of(rows), strict) for k, x in enumerate(c)]

    return by_page(df.select("page_id", "item_id", "text", "x1", "y1", "x2", "y2", "confidence", "locked"), kernel, "page_id bigint, item_id bigint, chain bigint, place int")


def chained_on_rasters(items: DataFrame, rasters: DataFrame) -> DataFrame:
    """The strict chains of each page, no step across a dark bar of the page's raster."""

    def kernel(rows: list, image: np.ndarray | None) -> list[tuple]:
        barred = None if image is None else lambda a, b: raster.bar_between(image, a["box"], b["box"])
        return [(rows[0].page_id, x["id"], c[0]["id"], k) for c in greedy.chains(rows_of(rows), True, barred) for k, x in enumerate(c)]

    return on_items(upright(items).select(*COLUMNS), rasters, kernel, "page_id bigint, item_id bigint, chain bigint, place int")


def merged_lines(items: DataFrame, strict: bool = True, params: Params = DEFAULT) -> DataFrame:
    """Near-horizontal lines joined to paragraphs, turned ones as they are; chain names the block. The items are stored, since three steps read them."""
    items = stored(upright(items))
    flat = items.filter(F.abs("angle") < params.near_horizontal)
    turned = items.filter(F.abs("angle") >= params.near_horizontal).withColumn("chain", F.col("item_id"))
    c = chained(flat, strict).select(F.col("page_id").alias("__p"), F.col("item_id").alias("__i"), "chain")
    both = flat.join(c, same_item()).drop("__p", "__i").withColumn("angle", F.lit(0.0)).unionByName(turned)
    # A block of several lines lies flat; a turned item is a block of its own and keeps its angle.
    return aggregates.blocks(both, ["page_id", "chain", "angle"], 0.0 if strict else None)


def anchored_lines(lines: DataFrame, reach: int = 5) -> DataFrame:
    """page_id, orient, pos and anchor: positions merged with the first existing one within reach.

    A position farther than the reach from the one before it is an anchor, so each run of near positions is for itself. Within
    it anchors lie over the reach apart, and the last one before a position is the only one that can be near: one fold a run.
    """
    apart = F.col("pos") - F.lag("pos").over(Window.partitionBy("page_id", "orient").orderBy("pos")) > reach
    run = F.sum(F.when(apart, 1).otherwise(0)).over(Window.partitionBy("page_id", "orient").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.select("page_id", "orient", "pos").filter("pos IS NOT NULL").distinct().withColumn("run", run)
    at = placed.groupBy("page_id", "orient", "run").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    none = F.array().cast("array<struct<pos:int,anchor:int>>")

    def step(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)["anchor"]
        return F.concat(done, F.array(F.struct(p.cast("int").alias("pos"), F.when(p - last <= reach, last).otherwise(p).cast("int").alias("anchor"))))

    return at.select("page_id", "orient", F.explode(F.aggregate("ps", none, step)).alias("a")).select("page_id", "orient", "a.pos", "a.anchor")


def enclosed_cells(lines: DataFrame, params: Params = DEFAULT, reach: int = 5) -> DataFrame:
    """page_id and boxes of the cells between the lines of each page: ``anchored_lines``, ``line_crossings``, ``grid_cells`` and ``closed_sides`` in one call a page.

    ``lines`` has page_id, orient, pos, lo and hi. A page's cells are many times its lines and their sides four times that: they
    are neither dealt nor met with each segment. What the narrower tolerance finds closed the wider one does too.
    """
    sizes = (params.cell_min_w, params.cell_max_w), (params.cell_min_h, params.cell_max_h)

    def kernel(rows: list) -> list[tuple]:
        segments = [(r.orient, int(r.pos), int(r.lo), int(r.hi)) for r in rows]
        return [(rows[0].page_id, *c) for c in grid.cells(segments, reach, params.crossing_window, params.min_crossings, *sizes, max(params.side_tolerances))]

    there = lines.filter("pos IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL")
    return by_page(there.select("page_id", "orient", "pos", "lo", "hi"), kernel, "page_id bigint, x1 int, y1 int, x2 int, y2 int")


def split_across_cells(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items of several lines cut where cell borders cross them: part counts from 0; other columns stay.

    A line at some height of the box cuts the text before the row that it stands in; each part takes its rows' share of the height.
    A page's distinct positions, no more than its pixels, go to its items as a list: items are dealt by page alone.
    """
    at = lines.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("__p")).agg(F.array_sort(F.collect_set("pos")).alias("__pos"))
    crossing = F.filter("__pos", lambda p: (p > F.col("y1")) & (p < F.col("y2")))
    met = items.join(at, F.col("page_id") == F.col("__p"), "left").withColumn("lines", F.when(F.size(crossing) > 0, crossing)).drop("__p", "__pos")
    n, tall = F.size("__rows"), F.col("y2") - F.col("y1")
    row = lambda y: F.least(n, F.floor((y - F.col("y1")) / tall / (F.lit(1.0) / n)).cast("int"))
    edges = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("lines", row), F.array(n)))
    cut = met.withColumn("__rows", F.split("text", "\n", -1)).withColumn("__edges", F.when(F.col("lines").isNotNull() & (n > 1) & (tall > 0), edges).otherwise(F.array(F.lit(0), n)))
    parts = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(2), F.size("__edges")) - 2)))
    a, b = F.get("__edges", F.col("part")), F.get("__edges", F.col("part") + 1)
    at = lambda k: (F.col("y1") + tall * k / n).cast("int")
    whole = F.size("__edges") <= 2
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice("__rows", a + 1, b - a), "\n"))
    made = {"text": text, "y1": F.when(whole, F.col("y1")).otherwise(at(a)), "y2": F.when(whole, F.col("y2")).otherwise(at(b))}
    return parts.withColumns(made).drop("lines", "__rows", "__edges")


def merged_items(items: DataFrame, cells: DataFrame, params: Params = DEFAULT, segments: DataFrame | None = None, page_w: int = 0, page_h: int = 0) -> DataFrame:
    """Blocks of each page: items of one cell together, the rest joined to paragraphs, turned ones alone; kind tells which.

    Items of several lines are first cut at the cells' borders. Cut, numbering, cell and blocks all go by page, so items are dealt once
    for them; blocks and items outside all cells, each a group of its own with its row, are stored together. With ``segments``, items
    outside all cells that ruling lines enclose stand alone: no paragraph takes them in.
    """
    borders = cells.select("page_id", F.explode(F.array("y1", "y2")).alias("pos"))
    cut = split_across_cells(upright(items).select(*COLUMNS), borders)
    # Parts are items of their own from here on.
    cut = sequences.numbered(cut, ["page_id"], ["item_id", "part"], "item_id").drop("part")
    sides = ["c_x1", "c_y1", "c_x2", "c_y2"]
    free = F.col("c_x1").isNull()
    own = F.when(free, F.struct(*[c for c in COLUMNS if c != "page_id"]))
    at = spatial.with_best_cell(cut, cells, params).withColumns({"own": own, "own_id": F.when(free, F.col("item_id"))})
    grouped = stored(aggregates.blocks(at, ["page_id", *sides, "own_id"], 1.0, {"own": F.any_value("own")}))
    by_cell = grouped.filter("own IS NULL").withColumns({"kind": F.lit("cell"), "angle": F.lit(0.0)}).drop(*sides, "own_id", "own")
    outside = grouped.filter("own IS NOT NULL").select("page_id", "own.*")
    if segments is not None:
        enclosed = spatial.bounding_cells(outside, segments, page_w, page_h, params).select(F.col("page_id").alias("__p"), F.col("item_id").alias("__i"), F.lit(True).alias("locked"))
        outside = outside.join(enclosed, same_item(), "left").drop("__p", "__i").withColumn("locked", F.coalesce("locked", F.lit(False)))
    by_line = merged_lines(outside, False, params).withColumn("kind", F.lit("text")).drop("chain")
    return by_cell.unionByName(by_line)

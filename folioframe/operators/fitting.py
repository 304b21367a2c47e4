"""Placement of texts in boxes, one row per line or character. Text is fitted in Arrow batches; boxes stay columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fitting
from ..functions.fitting import Metrics, TableMetrics
from .paging import by_page

PLACED = "page_id bigint, item_id bigint, line_no int, text string, x double, y double, font_size double, overflow boolean"
NAMES = [c.split()[0] for c in PLACED.split(", ")]


def placed(items: DataFrame, each: Callable[[tuple], list[tuple]]) -> DataFrame:
    """Run ``each`` on every row; it returns (line_no, text, x, y, font_size, overflow)."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r.page_id, r.item_id, *p) for r in frame.itertuples(index=False) for p in each(r)], columns=NAMES)

    return items.select("page_id", "item_id", F.coalesce("text", F.lit("")).alias("text"), "x1", "y1", "x2", "y2", "size").mapInPandas(kernel, PLACED)


def fitted_lines(items: DataFrame, metrics: Metrics | TableMetrics = Metrics(), unified: bool = False) -> DataFrame:
    """Lines of the largest size that fits each box: from ``size`` down to 5, or to 4 with every run cut by characters (unified)."""
    kw = {"min_size": 4, "spacing": 0.10, "least_spacing": 0, "break_all": True} if unified else {}

    def starting(text: str, w: int, h: int, size: int) -> fitting.Fit:
        return fitting.fitted(text, w, h, size, metrics, **kw)

    fit = fitting.remembered(starting)

    def each(r) -> list[tuple]:
        f = fit(r.text, r.x2 - r.x1, r.y2 - r.y1, int(r.size))
        step = metrics.line_height(f.size) + f.spacing
        return [(k, line, float(r.x1), float(r.y1 + k * step), float(f.size), f.overflow) for k, line in enumerate(f.lines)]

    return placed(items, each)


def horizontal_lines(items: DataFrame, metrics: Metrics | TableMetrics = Metrics()) -> DataFrame:
    """Lines by the scale, wrap and shrink rule."""

    def each(r) -> list[tuple]:
        f = fitting.horizontal(r.text, (r.x1, r.y1, r.x2, r.y2), float(r.size), metrics)
        return [(k, line, float(f["x"]), float(f["y"] + k * f["size"] * 1.2), float(f["size"]), False) for k, line in enumerate(f["lines"])]

    return placed(items, each)


def vertical_characters(items: DataFrame, metrics: Metrics | TableMetrics = Metrics()) -> DataFrame:
    """Characters set from the bottom up; overflow where one lies beyond the box."""

    def each(r) -> list[tuple]:
        return [(k, c["char"], float(c["x"]), float(c["y"]), float(c["size"]), bool(c["y"] < r.y1)) for k, c in enumerate(fitting.vertical(r.text, (r.x1, r.y1, r.x2, r.y2), float(r.size), metrics))]

    return placed(items, each)


def rotated_layers(items: DataFrame, metrics: Metrics | TableMetrics = Metrics()) -> DataFrame:
    """One centred layer for each turned item; its box's sides are the layer's."""

    def each(r) -> list[tuple]:
        w, h = float(r.x2 - r.x1), float(r.y2 - r.y1)
        f = fitting.rotated(r.text, (w, h), (w, h), metrics)
        return [(0, r.text, r.x1 + w / 2, r.y1 + h / 2, float(f["size"]), bool(f["overflow"]))]

    return placed(items, each)


def quad_layers(items: DataFrame) -> DataFrame:
    """angle, layer_w, layer_h, left and top of each turned item's layer, as columns beside the item's.

    ``items`` has a quad, an array of four points x and y, beside the box. The layer is as long as the quad's longer side and as
    high as its shorter one, within the box's longer and shorter side; turned, it is centred in the box: left and top are the
    places of its upper left corner there, negative where it is larger. What lies outside the quad is cut away by ``in_quad``.
    """
    point = lambda k: F.get("quad", k)
    dx, dy = point(1)["x"] - point(0)["x"], point(1)["y"] - point(0)["y"]
    ex, ey = point(3)["x"] - point(0)["x"], point(3)["y"] - point(0)["y"]
    one = F.lit(1.0)
    side = lambda x, y: F.greatest(one, F.rint(F.sqrt((x * x + y * y).cast("double"))))
    base, other = side(dx, dy), side(ex, ey)
    w, h = F.greatest(F.lit(1), F.col("x2") - F.col("x1")), F.greatest(F.lit(1), F.col("y2") - F.col("y1"))
    out = items.withColumns(
        {
            "angle": F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))),
            "layer_w": F.greatest(one, F.least(F.greatest(base, other), F.greatest(w, h))).cast("int"),
            "layer_h": F.greatest(one, F.least(F.least(base, other), F.least(w, h))).cast("int"),
        }
    )
    turn = F.radians("angle")
    across = F.ceil(F.round(F.abs(F.col("layer_w") * F.cos(turn)) + F.abs(F.col("layer_h") * F.sin(turn)), 6))
    down = F.ceil(F.round(F.abs(F.col("layer_w") * F.sin(turn)) + F.abs(F.col("layer_h") * F.cos(turn)), 6))
    return out.withColumns({"left": ((w - across) / 2).cast("int"), "top": ((h - down) / 2).cast("int")})


def in_quad(x: Column, y: Column, quad: str = "quad") -> Column:
    """Whether a point lies in a convex quad, sides included: on one side of all four."""
    crosses = []
    for k in range(4):
        a, b = F.get(quad, k), F.get(quad, (k + 1) % 4)
        crosses.append((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return (F.least(*crosses) >= 0) | (F.greatest(*crosses) <= 0)


def layer_texts(layers: DataFrame, metrics: Metrics | TableMetrics = Metrics()) -> DataFrame:
    """Lines of every layer (layer_w by layer_h) with their tops inside it."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lay = fitting.remembered(lambda text, w, h: fitting.layer_lines(text, w, h, metrics))
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                fit, lines = lay(r.text, r.layer_w, r.layer_h)
                out += [(r.page_id, r.item_id, k, line, 0.0, float(top), float(fit.size), fit.overflow) for k, (line, top) in enumerate(lines)]
            yield pd.DataFrame(out, columns=NAMES)

    return layers.select("page_id", "item_id", F.coalesce("text", F.lit("")).alias("text"), "layer_w", "layer_h").mapInPandas(kernel, PLACED)


def single_line(metrics: Metrics | TableMetrics = Metrics()) -> dict[str, Column]:
    """Size and state of the horizontal rule's first two steps as columns: whole, scaled, or still too wide."""
    w = F.col("x2") - F.col("x1")
    wide = metrics.column_width(F.col("text")) * F.col("size")
    scale = F.greatest(w / F.greatest(wide, F.lit(1e-9)), F.lit(0.4))
    state = F.when(wide <= w * 1.05, "whole").when(wide * scale <= w * 1.1, "scaled").otherwise("wrap")
    return {"fit_state": state, "fit_size": F.when(state == "whole", F.col("size")).otherwise(F.col("size") * scale)}


def erase_boxes(items: DataFrame, inset: int = 1, page_w: int | None = None, page_h: int | None = None) -> DataFrame:
    """Boxes to erase: inset on all sides (negative: widened), inside the page, and empty ones left out."""
    x1, y1, x2, y2 = F.col("x1") + inset, F.col("y1") + inset, F.col("x2") - inset, F.col("y2") - inset
    x1, y1 = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1)
    x2 = x2 if page_w is None else F.least(F.lit(page_w), x2)
    y2 = y2 if page_h is None else F.least(F.lit(page_h), y2)
    return items.select("page_id", "item_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).filter("x2 > x1 AND y2 > y1")


def line_boxes(blocks: DataFrame) -> DataFrame:
    """Each line of a translation in its own source line's box if the counts agree; else the whole text in the whole box."""
    lines = F.split("translated", "\n", -1)
    own = F.size(lines) == F.size("sub_bboxes")
    whole = F.array(F.struct(F.col("translated").alias("text"), F.struct("x1", "y1", "x2", "y2").alias("box")))
    each = F.zip_with(lines, "sub_bboxes", lambda a, b: F.struct(a.alias("text"), b.alias("box")))
    return blocks.select("page_id", "chain", F.posexplode(F.when(own, each).otherwise(whole)).alias("line_no", "p")).select("page_id", "chain", "line_no", "p.text", "p.box.*")


def clipped_layer(x: Column, y: Column, w: Column, h: Column, page_w: int, page_h: int) -> dict[str, Column]:
    """The part of a layer that lies on the page; empty layers have no width."""
    left, top = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return {"x": left, "y": top, "w": F.greatest(F.lit(0), F.least(F.lit(page_w), x + w) - left), "h": F.greatest(F.lit(0), F.least(F.lit(page_h), y + h) - top)}


def cell_erase_boxes(cells: DataFrame, mean_level: str = "mean_level", inset: int = 2) -> DataFrame:
    """Whole cells to erase, inset by two, in white on light ground and in the inverted grey on dark."""
    fill = F.when(F.col(mean_level) > 200, F.lit(255)).otherwise(F.lit(240))
    out = cells.select("page_id", (F.col("x1") + inset).alias("x1"), (F.col("y1") + inset).alias("y1"), (F.col("x2") - inset).alias("x2"), (F.col("y2") - inset).alias("y2"), fill.alias("fill"))
    return out.filter("x2 > x1 AND y2 > y1")


def cell_layout(assigned: DataFrame, metrics: Metrics | TableMetrics = Metrics(), max_size: int = 40) -> DataFrame:
    """Rows of each cell below each other, each with its share of the height by its item's height: one size for the cell if one fits all rows, else each row's own.

    ``assigned`` has the cell's box as c_ columns beside each item. A page's items are what one call sees.
    """

    def one_cell(rows: list) -> list[tuple]:
        first = rows[0]
        w, h, top = first.c_x2 - first.c_x1, first.c_y2 - first.c_y1, first.c_y1
        heights = [max(1, r.y2 - r.y1) for r in rows]
        shares = [max(1, x * h // sum(heights)) for x in heights]
        size = fitting.uniform([r.text for r in rows], [float(s) for s in shares], w, max_size, metrics)
        out = []
        for r, share in zip(rows, shares, strict=True):
            if size is None:
                fit = fitting.fitted(r.text, w, share, max_size, metrics)
                lines, own, over = fit.lines, fit.size, fit.overflow
            else:
                lines, own, over = fitting.wrapped(r.text, size, w, metrics), size, False
            step = metrics.line_height(own)
            out += [(r.page_id, r.item_id, k, line, float(r.c_x1), float(top + k * step), float(own), over) for k, line in enumerate(lines)]
            top += share
        return out

    def kernel(rows: list) -> list[tuple]:
        cell = lambda r: (r.c_y1, r.c_x1, r.c_y2, r.c_x2)
        return [p for _, g in groupby(sorted(rows, key=lambda r: (*cell(r), r.y1, r.item_id)), cell) for p in one_cell(list(g))]

    cols = ["page_id", "item_id", F.coalesce("text", F.lit("")).alias("text"), "y1", "y2", "c_x1", "c_y1", "c_x2", "c_y2"]
    return by_page(assigned.select(*cols), kernel, PLACED)

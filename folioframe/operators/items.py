"""Projections, filters and parsers of text items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import text as t
from ..params import DEFAULT, Params


def gated(items: DataFrame, script: str | None = t.HAN, params: Params = DEFAULT) -> DataFrame:
    """Items of the script and with enough confidence."""
    out = items.filter(F.coalesce(F.col("confidence"), F.lit(0.0)) >= params.min_confidence)
    return out if script is None else out.filter(t.has_script(F.col("text"), script))


def clamp(items: DataFrame, page_w: int | Column, page_h: int | Column) -> DataFrame:
    """Boxes put inside the page, with their new width and height."""
    return items.withColumns(g.clamped(g.box(), F.lit(page_w), F.lit(page_h)))


def quad_items(rows: DataFrame, params: Params = DEFAULT, script: str | None = None) -> DataFrame:
    """Recogniser rows (quad, text, conf, tile_x, tile_y) as items: trimmed, gated, moved to the page, with box and angle."""
    moved = F.transform("quad", lambda p: F.struct((p["x"] + F.col("tile_x")).alias("x"), (p["y"] + F.col("tile_y")).alias("y")))
    out = rows.withColumn("text", t.strip(F.col("text"))).filter((F.col("text") != "") & (F.col("conf") >= params.min_confidence))
    out = out if script is None else out.filter(t.has_script(F.col("text"), script))
    out = out.withColumn("quad", moved)
    return out.withColumns(g.quad_box(F.col("quad"))).withColumns(
        {"angle": g.baseline_angle(F.col("quad")), "confidence": F.round("conf", 3), "width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")}
    )


def layout_items(results: DataFrame, from_poly: bool = True, params: Params = DEFAULT) -> DataFrame:
    """Parallel arrays of a layout engine as items. Boxes come from polygons (with the confidence gate) or from rec_boxes (without)."""
    at = F.posexplode("rec_texts").alias("pos", "text")
    rows = results.select("page_id", "rec_scores", "rec_boxes", "rec_polys", at).withColumn("text", t.strip(F.col("text"))).filter("text <> ''")
    rows = rows.withColumn("confidence", F.coalesce(F.get("rec_scores", F.col("pos")), F.lit(0.0)))
    if from_poly:
        poly = F.get("rec_polys", F.col("pos"))
        rows = rows.filter((F.col("confidence") >= params.min_confidence) & poly.isNotNull()).withColumns(g.quad_box(poly))
    else:
        b = F.get("rec_boxes", F.col("pos"))
        rows = rows.filter(F.size(b) >= 4).withColumns({c: F.get(b, k).cast("int") for k, c in enumerate(("x1", "y1", "x2", "y2"))})
    return rows.select("page_id", "pos", "text", "confidence", "x1", "y1", "x2", "y2")


def table_cells(results: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cell lists of a table engine, all of its fields together, as distinct boxes: normalised and within the size limits."""
    found = F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<array<int>>")) for c in ("cell_box_list", "cell_boxes", "table_cells")])).alias("b")
    rows = results.select("page_id", found).filter(F.size("b") >= 4)
    at = tuple(F.get("b", k) for k in range(4))
    rows = rows.select("page_id", *[c.alias(n) for n, c in g.ordered_corners(at).items()])
    return cell_gate(rows, params).distinct()


def span_items(pages: DataFrame, script: str | None = None) -> DataFrame:
    """Pages of nested blocks, lines, spans and characters as items: text from characters, trimmed, empty ones dropped."""
    spans = (
        pages.select("page", F.posexplode("blocks").alias("b", "block"))
        .filter("block.type = 0")
        .select("page", "b", F.posexplode("block.lines").alias("l", "line"))
        .select("page", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    )
    text = t.strip(F.array_join(F.transform("span.chars", lambda c: c["c"]), ""))
    out = spans.withColumn("text", text).filter("text <> ''")
    return out if script is None else out.filter(t.has_script(F.col("text"), script))


def orientation(chars: DataFrame, key: list[str], order: str) -> DataFrame:
    """is_vertical and direction of every group of character origins (x, y) in order; wmode 1 forces is_vertical alone."""
    w = Window.partitionBy(*key).orderBy(order)
    steps = chars.withColumns({"dx": F.abs(F.col("x") - F.lag("x").over(w)), "dy": F.abs(F.col("y") - F.lag("y").over(w))})
    ends = F.struct(F.col(order).alias("o"), "x", "y")
    s = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.min(ends).alias("a"), F.max(ends).alias("b"), F.max("wmode").alias("wmode"))
    vertical = (F.col("n") >= 2) & (F.col("sy") > 0) & ((F.col("sx") == 0) | (F.col("sy") > 1.5 * F.col("sx")))
    turn = F.degrees(F.atan2((F.col("b.y") - F.col("a.y")).cast("double"), (F.col("b.x") - F.col("a.x")).cast("double")))
    direction = F.when(F.col("n") < 2, "horizontal").when(vertical, "vertical").when(F.abs(turn) > 5, "rotated").otherwise("horizontal")
    return s.select(*key, F.col("n").alias("n_chars"), (vertical | (F.col("wmode") == 1)).alias("is_vertical"), direction.alias("direction"))


def near_horizontal(angle: Column, params: Params = DEFAULT) -> Column:
    return F.abs(angle) < params.near_horizontal


def cell_gate(cells: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cells within the size limits."""
    b = g.box()
    return cells.filter(g.width(b).between(params.cell_min_w, params.cell_max_w) & g.height(b).between(params.cell_min_h, params.cell_max_h))


def component_gate(cells: DataFrame, page_area: int, params: Params = DEFAULT) -> DataFrame:
    """Components large enough, not the page itself, and not thin lines."""
    b = g.box()
    thin = F.greatest(g.width(b), g.height(b)) / F.greatest(F.lit(1), F.least(g.width(b), g.height(b)))
    return cells.filter((g.area(b) >= params.component_min_area) & (g.area(b) <= params.component_max_share * page_area) & (thin <= params.component_max_aspect))


def contour_gate(contours: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Contours that fill their box and lie on white: contour_area and white_ratio are measured columns."""
    filled = F.col("contour_area") / F.greatest(F.lit(1), g.area(g.box()))
    return contours.filter((filled >= params.rectangularity) & (F.col("white_ratio") >= params.white_share))


def segment_kind(segments: DataFrame) -> DataFrame:
    """Segments within 15 degrees of flat (h) or upright (v), with position and range; slanted ones go."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    angle = F.when(dx == 0, F.lit(90.0)).otherwise(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))))
    orient = F.when(angle < 15, "h").when(angle > 75, "v")
    flat = F.col("orient") == "h"
    out = segments.withColumn("orient", orient).filter("orient IS NOT NULL")
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    return out.select(
        "page_id", "item_id", "orient",
        F.when(flat, mid("y1", "y2")).otherwise(mid("x1", "x2")).alias("pos"),
        F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"),
        F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi"),
    )


def text_colour(mean_level: Column) -> Column:
    """Black on light ground, white on dark."""
    return F.when(mean_level > 128, "black").otherwise("white")


def alignment(left_dark: Column, right_dark: Column, text_share: Column) -> Column:
    """right, center or left by the shares of dark pixels at a box's two edges; text that fills the box is left."""
    return (
        F.when(text_share >= 0.9, "left")
        .when((right_dark > 0.05) & (left_dark < 0.02), "right")
        .when(F.abs(left_dark - right_dark) < 0.03, "center")
        .otherwise("left")
    )


def page_kind(pages: DataFrame, script: str = t.HAN, first: int = 3) -> DataFrame:
    """vector for documents with the script on one of the first pages, else scan. ``pages`` has doc_id, page_no (from 0) and text."""
    seen = F.bool_or((F.col("page_no") < first) & t.has_script(F.col("text"), script))
    return pages.groupBy("doc_id").agg(F.when(F.coalesce(seen, F.lit(False)), "vector").otherwise("scan").alias("kind"))

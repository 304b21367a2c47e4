"""Spatial joins inside pages.

Every join is an equality on the page, so Spark hashes pages over the cluster, plus a residual condition in the
generated code. Where a page may be dense, boxes are also dealt to the squares of a grid that they touch and meet
by square: a pair is kept in one square only, that of the upper left corner of what the two share. What asks whether a box
lies in another looks up the square of its upper left corner only; what asks for something near widens one side by the reach.

Boxes and pages that are null meet nothing; equal boxes and repeated rows are rows of their own unless an operator says
otherwise; of equally good partners the upper, then the left one or the smaller number counts; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..params import DEFAULT, Params
from ..session import stored
from .paging import dealt

BOX = ["x1", "y1", "x2", "y2"]
#: Side of a grid square in pixels.
SQUARE = 512


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All columns but the kept ones under a prefix."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def squares(df: DataFrame, prefix: str = "", side: int = SQUARE, reach: int = 0) -> DataFrame:
    """A row for every grid square that a box, widened by ``reach``, touches: gx and gy."""
    x1, y1, x2, y2 = g.box(prefix)
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - reach) / side), F.floor((hi + reach) / side)))
    return df.withColumn("gx", spread(x1, x2)).withColumn("gy", spread(y1, y2))


def overlapping(a: DataFrame, b: DataFrame, side: int = SQUARE) -> DataFrame:
    """Pairs of boxes of one page that share area, columns a_ and b_; each pair once."""
    left = squares(prefixed(a, "a_"), "a_", side)
    right = squares(prefixed(b, "b_"), "b_", side).withColumnsRenamed({"page_id": "__page", "gx": "__gx", "gy": "__gy"})
    pa, pb = g.box("a_"), g.box("b_")
    owner = (F.floor(F.greatest(pa[0], pb[0]) / side) == F.col("gx")) & (F.floor(F.greatest(pa[1], pb[1]) / side) == F.col("gy"))
    met = left.join(right, (F.col("page_id") == F.col("__page")) & (F.col("gx") == F.col("__gx")) & (F.col("gy") == F.col("__gy")) & owner & (g.overlap_x(pa, pb) > 0) & (g.overlap_y(pa, pb) > 0))
    return met.drop("__page", "__gx", "__gy", "gx", "gy")


def best_cell(items: DataFrame, cells: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """page_id, item_id and the cell (c_x1 ...) that holds more than half of each item; the largest share wins, ties to the first cell by top and left."""
    pairs = overlapping(items.select("page_id", "item_id", *BOX), cells.select("page_id", *BOX))
    shared = g.overlap_area(g.box("a_"), g.box("b_"))
    pairs = pairs.withColumn("overlap", shared).filter((F.col("overlap") > 0) & (F.col("overlap") > params.assign_share * g.area(g.box("a_"))))
    # One struct per item instead of a window: the maximum is combined before the shuffle.
    best = F.max(F.struct("overlap", (-F.col("b_y1")).alias("t"), (-F.col("b_x1")).alias("l"), "b_x2", "b_y2")).alias("m")
    found = pairs.groupBy("page_id", F.col("a_item_id").alias("item_id")).agg(best)
    return found.select("page_id", "item_id", F.col("m.overlap").alias("overlap"), (-F.col("m.l")).alias("c_x1"), (-F.col("m.t")).alias("c_y1"), F.col("m.b_x2").alias("c_x2"), F.col("m.b_y2").alias("c_y2"))


def with_best_cell(items: DataFrame, cells: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Items with the cell (c_x1 ...) that ``best_cell`` finds for each, null where there is none.

    The cells of a page go to its items as lists by square, and an item looks through the lists of the squares that it touches:
    items are dealt by page alone, and not at all where they are so dealt before.
    """
    # Dealt by the session's number of partitions, as the items are: by another number, the larger side would be dealt anew.
    there = squares(cells.select(F.col("page_id").alias("__p"), *BOX).filter("__p IS NOT NULL").repartition("__p"))
    lists = there.groupBy("__p", "gx", "gy").agg(F.collect_set(F.struct(*BOX)).alias("cells")).groupBy("__p").agg(F.collect_list(F.struct("gx", "gy", "cells")).alias("__s"))
    x1, y1, x2, y2 = a = g.box()
    near = F.filter("__s", lambda s: s["gx"].between(F.floor(x1 / SQUARE), F.floor(x2 / SQUARE)) & s["gy"].between(F.floor(y1 / SQUARE), F.floor(y2 / SQUARE)))
    shared = lambda c: g.overlap_area(a, tuple(c[k] for k in BOX))
    fits = lambda m: (m["overlap"] > 0) & (m["overlap"] > params.assign_share * g.area(a))
    rank = lambda c: F.struct(shared(c).alias("overlap"), (-c["y1"]).alias("t"), (-c["x1"]).alias("l"), c["x2"].alias("x2"), c["y2"].alias("y2"))
    best = F.array_max(F.filter(F.transform(F.flatten(F.transform(near, lambda s: s["cells"])), rank), fits))
    found = items.join(lists, F.col("page_id") == F.col("__p"), "left").withColumn("__m", best)
    sides = {"c_x1": -F.col("__m.l"), "c_y1": -F.col("__m.t"), "c_x2": F.col("__m.x2"), "c_y2": F.col("__m.y2")}
    return found.select(*items.columns, *[c.alias(k) for k, c in sides.items()])


def ladder(df: DataFrame, prefix: str, side: Column, reach: Column) -> DataFrame:
    """A row for every square of the row's own ``side`` that its box, widened by ``reach``, touches: gx and gy."""
    x1, y1, x2, y2 = g.box(prefix)
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - reach) / side), F.floor((hi + reach) / side)))
    return df.withColumn("gx", spread(x1, x2)).withColumn("gy", spread(y1, y2))


def nearest_cell_gap(items: DataFrame, cells: DataFrame, reach: int = SQUARE) -> DataFrame:
    """page_id, item_id and the distance to the nearest cell of the page; items of pages without cells have no row.

    What touches shares a square, so most items are done where both are dealt as they are; this is stored. For the others the cells
    of their pages are widened by reach. An item that has none so near looks at squares of doubling side until one around it
    holds a cell. The nearest cell is then at most two sides away, and is looked for in the squares of that side only.
    """
    a = prefixed(items.select("page_id", "item_id", *BOX), "a_")
    b = prefixed(cells.select("page_id", *BOX), "b_")
    item = [F.col("page_id"), F.col("a_item_id").alias("item_id")]
    ids = lambda df: df.select(F.col("page_id").alias("__p"), F.col("item_id").alias("__i"))
    same = (F.col("page_id") == F.col("__p")) & (F.col("a_item_id") == F.col("__i"))
    apart = g.gap(g.box("a_"), g.box("b_"))
    gap = F.min(apart).alias("gap")
    dealt_cells = squares(b, "b_").withColumnsRenamed({"page_id": "__p", "gx": "__gx", "gy": "__gy"})
    touch = (F.col("page_id") == F.col("__p")) & (F.col("gx") == F.col("__gx")) & (F.col("gy") == F.col("__gy")) & (apart == 0)
    looked = stored(squares(a, "a_").join(dealt_cells, touch, "left").groupBy(*item).agg(F.min(F.when(F.col("__p").isNotNull(), apart)).alias("gap")))
    done, open_ids = looked.filter("gap IS NOT NULL"), ids(looked.filter("gap IS NULL"))
    if open_ids.isEmpty():
        return done
    # Stored boxes are few bytes; Spark would send all their squares to every executor: it is to sort both sides.
    rest = stored(a.join(open_ids, same, "left_semi")).hint("merge")
    b = stored(b.join(open_ids.select("__p").distinct(), F.col("page_id") == F.col("__p"), "left_semi")).hint("merge")
    met = squares(rest, "a_").join(squares(b, "b_", reach=reach), ["page_id", "gx", "gy"])
    near = stored(met.groupBy(*item).agg(gap).filter(F.col("gap") <= reach))
    done = done.unionByName(near)
    far = stored(rest.join(ids(near), same, "left_anti")).hint("merge")
    if far.isEmpty():
        return done
    boxes = lambda df, prefix: df.select(*[F.col(prefix + c).alias(c) for c in BOX])
    ends = [F.min("x1"), F.max("x2"), F.min("y1"), F.max("y2")]
    left, right, top, bottom = boxes(far, "a_").unionByName(boxes(b, "b_")).agg(*ends).first()
    span = 0 if left is None or top is None else max(right - left, bottom - top)
    levels = max(1, math.ceil(math.log2(max(span, 1) / reach)) + 1)  # squares of the last level are as large as any page
    step = lambda df: df.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    side = F.lit(reach) * F.pow(F.lit(2), F.col("level"))
    at = ["page_id", "level", "gx", "gy"]
    held = ladder(step(b), "b_", side, F.lit(0))
    found = ladder(step(far), "a_", side, side).join(held.select(*at).distinct(), at, "left_semi")
    level = found.groupBy("page_id", "a_item_id", *[f"a_{c}" for c in BOX]).agg(F.min("level").alias("level"))
    return done.unionByName(ladder(level, "a_", side, 2 * side).join(held, at).groupBy(*item).agg(gap))


def outer_squares(cells: DataFrame, *more: str) -> DataFrame:
    """Boxes b_ as containers: page, square, box and more columns."""
    return squares(prefixed(cells.select("page_id", *BOX, *more), "b_", ()), "b_").withColumnsRenamed({"gx": "b_gx", "gy": "b_gy"})


def in_outer() -> Column:
    """Whether a container is on the page, covers the square of the inner box's upper left corner, and holds the box."""
    x1, y1, _, _ = g.box()
    at = (F.floor(x1 / SQUARE) == F.col("b_gx")) & (F.floor(y1 / SQUARE) == F.col("b_gy"))
    return (F.col("page_id") == F.col("b_page_id")) & at & g.contains(g.box("b_"), g.box())


def without_contained(cells: DataFrame) -> DataFrame:
    """Cells that no cell of strictly larger area contains."""
    return cells.join(outer_squares(cells), in_outer() & (g.area(g.box("b_")) > g.area(g.box())), "left_anti")


def outside_protected(cells: DataFrame, protected: Column | None = None) -> DataFrame:
    """All protected cells, and the others that lie in no different protected cell."""
    a = cells.withColumn("__p", F.col("morph") if protected is None else protected)
    same = (F.col("x1") == F.col("b_x1")) & (F.col("y1") == F.col("b_y1")) & (F.col("x2") == F.col("b_x2")) & (F.col("y2") == F.col("b_y2"))
    return a.join(outer_squares(a.filter("__p")), ~F.col("__p") & ~same & in_outer(), "left_anti").drop("__p")


def outermost(cells: DataFrame) -> DataFrame:
    """What ``without_contained(outside_protected(cells))`` keeps, in one join; morph tells what is protected.

    A larger cell that the first step drops lies in a protected one, which is as large, holds what that one holds, and stays.
    """
    same = (F.col("x1") == F.col("b_x1")) & (F.col("y1") == F.col("b_y1")) & (F.col("x2") == F.col("b_x2")) & (F.col("y2") == F.col("b_y2"))
    barred = F.col("b_morph") & ~F.col("morph") & ~same
    return cells.join(outer_squares(cells, "morph"), in_outer() & (barred | (g.area(g.box("b_")) > g.area(g.box()))), "left_anti")


def uncovered(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Items that lie in no cell."""
    return items.join(outer_squares(cells), in_outer(), "left_anti")


def with_partner(cells: DataFrame, others: DataFrame, reach: int, condition: Column, unique: bool = False) -> DataFrame:
    """Cells for which some other box b_, which lies within reach, fulfils the condition.

    ``unique`` says that no two rows have the same page and box: their columns then go along, and rows need not be looked up again.
    """
    wide = squares(cells if unique else cells.select("page_id", *BOX).distinct(), reach=reach)
    b = squares(prefixed(others.select("page_id", *BOX), "b_", ()), "b_").withColumnsRenamed({"gx": "b_gx", "gy": "b_gy"})
    near = (F.col("page_id") == F.col("b_page_id")) & (F.col("gx") == F.col("b_gx")) & (F.col("gy") == F.col("b_gy"))
    met = wide.join(b, near & condition, "left_semi").drop("gx", "gy")
    if unique:
        return dealt(met, "page_id").distinct()
    return cells.join(met.distinct(), ["page_id", *BOX], "left_semi").select(*cells.columns)


def cells_near_text(cells: DataFrame, items: DataFrame, params: Params = DEFAULT, unique: bool = False) -> DataFrame:
    """Cells with an item's centre inside, with more than near_share of an item, or with an item's centre at near_distance at most."""
    c, i = g.box(), g.box("b_")
    cx, cy = g.centre_x(i), g.centre_y(i)
    inside = (cx >= c[0]) & (cx <= c[2]) & (cy >= c[1]) & (cy <= c[3])
    shares = g.overlap_area(c, i) > params.near_share * g.area(i)
    dx, dy = g.centre_x(c) - cx, g.centre_y(c) - cy
    near = dx * dx + dy * dy <= params.near_distance**2
    return with_partner(cells, items, params.near_distance, inside | shares | near, unique)


def grid_neighbours(cells: DataFrame, params: Params = DEFAULT, unique: bool = False) -> DataFrame:
    """Cells with a neighbour in their row or column; a page of one cell keeps it."""
    c, o = g.box(), g.box("b_")
    t, s = params.neighbour_align, params.neighbour_gap
    row = (F.abs(c[1] - o[1]) <= t) & (F.abs(c[3] - o[3]) <= t) & (F.least(F.abs(c[2] - o[0]), F.abs(o[2] - c[0])) <= s)
    col = (F.abs(c[0] - o[0]) <= t) & (F.abs(c[2] - o[2]) <= t) & (F.least(F.abs(c[3] - o[1]), F.abs(o[3] - c[1])) <= s)
    other = (c[0] != o[0]) | (c[1] != o[1]) | (c[2] != o[2]) | (c[3] != o[3])
    met = with_partner(cells, cells, max(t, s), other & (row | col), unique)
    # The first row of a page of one row is that row.
    firsts = [F.first(k).alias(k) for k in cells.columns if k != "page_id"]
    single = cells.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("__n"), *firsts).filter("__n = 1").drop("__n")
    return met.unionByName(single.select(*cells.columns))


def line_crossings(segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """page_id, orient, pos, crossings: lines with min_crossings crossing lines or more.

    ``segments`` has page_id, orient, pos, lo and hi. A line is crossed by a line of the other kind one of whose ranges,
    widened by the window, holds its position. Ranges of one line are joined where they overlap; what begins before a position
    and has not ended there is a running sum, so lines and ranges are sorted and do not meet in pairs.
    """
    w = params.crossing_window
    lines = segments.select("page_id", "orient", "pos").filter("page_id IS NOT NULL AND pos IS NOT NULL").distinct()
    ranges = segments.filter("page_id IS NOT NULL AND pos IS NOT NULL AND lo - {0} <= hi + {0}".format(w)).select("page_id", "orient", "pos", (F.col("lo") - w).alias("lo"), (F.col("hi") + w).alias("hi"))
    along = Window.partitionBy("page_id", "orient", "pos").orderBy("lo", "hi")
    so_far = ranges.withColumn("reached", F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("reached").over(along)).withColumn("next", F.lead("lo").over(along))
    other = F.when(F.col("orient") == "h", "v").when(F.col("orient") == "v", "h")
    begins = F.when(F.col("before").isNull() | (F.col("lo") > F.col("before")), F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("n")))
    ends = F.when(F.col("next").isNull() | (F.col("next") > F.col("reached")), F.struct(F.col("reached").alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("n")))
    steps = so_far.select("page_id", other.alias("orient"), F.explode(F.array_compact(F.array(begins, ends))).alias("s")).select("page_id", "orient", F.col("s.at").alias("pos"), "s.kind", "s.n")
    # At one position ranges begin before lines and end after them.
    every = lines.withColumns({"kind": F.lit(1), "n": F.lit(0)}).unionByName(steps)
    open_there = F.sum("n").over(Window.partitionBy("page_id", "orient").orderBy("pos", "kind").rangeBetween(Window.unboundedPreceding, 0))
    met = dealt(every, "page_id", "orient").withColumn("crossings", open_there).filter("kind = 1")
    return met.select("page_id", "orient", "pos", "crossings").filter(F.col("crossings") >= params.min_crossings)


def grid_cells(lines: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cells between each two neighbouring horizontal and vertical lines of a page, within the size limits."""
    nxt = F.lead("pos").over(Window.partitionBy("page_id", "orient").orderBy("pos"))
    pairs = dealt(lines.select("page_id", "orient", "pos"), "page_id").distinct().withColumn("next", nxt).filter("next IS NOT NULL")
    h = pairs.filter("orient = 'h'").select("page_id", F.col("pos").alias("y1"), F.col("next").alias("y2"))
    v = pairs.filter("orient = 'v'").select("page_id", F.col("pos").alias("x1"), F.col("next").alias("x2"))
    size = g.width(g.box()).between(params.cell_min_w, params.cell_max_w) & g.height(g.box()).between(params.cell_min_h, params.cell_max_h)
    return h.join(v, "page_id").filter(size).select("page_id", *BOX)


def closed_sides(cells: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cells with the number of their sides that a segment covers, three at least; the wider tolerance is the second try."""
    tol = params.side_tolerances
    sides = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("side"), F.lit(o).alias("s_orient"), F.col(p).alias("at"), F.col(a).alias("from"), F.col(b).alias("to"))
                for n, o, p, a, b in (("top", "h", "y1", "x1", "x2"), ("bottom", "h", "y2", "x1", "x2"), ("left", "v", "x1", "y1", "y2"), ("right", "v", "x2", "y1", "y2"))
            ]
        )
    )
    c = cells.select("page_id", *BOX, sides.alias("s"))
    s = segments.select(F.col("page_id").alias("b_page"), "orient", "pos", "lo", "hi")
    covers = None
    for t in tol:
        one = (F.abs(F.col("pos") - F.col("s.at")) <= t) & (F.col("lo") <= F.col("s.from") + t) & (F.col("hi") >= F.col("s.to") - t)
        covers = one if covers is None else covers | one
    met = c.join(s, (F.col("page_id") == F.col("b_page")) & (F.col("orient") == F.col("s.s_orient")) & covers, "left_semi")
    return met.groupBy("page_id", *BOX).agg(F.count(F.lit(1)).alias("sides")).filter("sides >= 3")


def bounding_lines(items: DataFrame, rulings: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """The nearest lines above, below, left and right of each item's centre; the page's border where there is none.

    An as-of join in four directions: a page's distinct positions, no more than its pixels, go to its items as two lists, so
    neither items nor lines are dealt or sorted by position.
    """
    cx, cy = F.floor(g.centre_x(g.box())).cast("int"), F.floor(g.centre_y(g.box())).cast("int")
    there = rulings.filter("page_id IS NOT NULL")
    lists = {o: F.collect_set(F.when(F.col("orient") == o, F.col("pos"))).alias(f"__{o}") for o in "hv"}
    lines = there.groupBy("page_id").agg(*lists.values()).withColumnRenamed("page_id", "__p")
    at = items.select("page_id", "item_id", cx.alias("__x"), cy.alias("__y")).join(lines, F.col("page_id") == F.col("__p"), "left")
    before = lambda o, c: F.array_max(F.filter(f"__{o}", lambda p: p <= F.col(c)))
    after = lambda o, c: F.array_min(F.filter(f"__{o}", lambda p: p >= F.col(c)))
    sides = {"x1": (before("v", "__x"), 0), "y1": (before("h", "__y"), 0), "x2": (after("v", "__x"), page_w), "y2": (after("h", "__y"), page_h)}
    return at.select("page_id", "item_id", *[F.coalesce(c, F.lit(border)).alias(k) for k, (c, border) in sides.items()])


def bounding_cells(items: DataFrame, segments: DataFrame, page_w: int, page_h: int, params: Params = DEFAULT) -> DataFrame:
    """page_id, item_id, try_no and the box that the nearest lines around each item's centre enclose, within the size limits.

    ``segments`` has page_id, orient, pos, lo and hi. A line counts if it has ink within a reach of the centre, measured along
    the line. The first of three tries counts that gives a box of fitting size: the near reach, the wide one, and the wide one
    with the page's border where a side has no line. Whether the box is white inside is a raster's matter (``raster.measured``).
    """
    near, wide = params.bounding_reach
    cx, cy = F.expr("(x1 + x2) DIV 2").cast("int"), F.expr("(y1 + y2) DIV 2").cast("int")
    points = items.select("page_id", "item_id", cx.alias("cx"), cy.alias("cy"))
    # Points and lines meet by strips across the lines, so that a dense page is spread.
    way = F.explode(F.array(F.struct(F.lit("h").alias("o"), F.col("cx").alias("along"), F.col("cy").alias("at")), F.struct(F.lit("v").alias("o"), F.col("cy").alias("along"), F.col("cx").alias("at")))).alias("w")
    p = points.select("page_id", "item_id", way).select("page_id", "item_id", "w.*", F.floor(F.col("w.along") / SQUARE).alias("strip"))
    strips = F.explode(F.sequence(F.floor((F.col("lo") - wide) / SQUARE), F.floor((F.col("hi") + wide) / SQUARE))).alias("b_strip")
    s = segments.filter("hi >= lo").select(F.col("page_id").alias("b_page"), "orient", "pos", "lo", "hi", strips)
    met = p.join(s, (F.col("page_id") == F.col("b_page")) & (F.col("o") == F.col("orient")) & (F.col("strip") == F.col("b_strip")) & F.col("along").between(F.col("lo") - wide, F.col("hi") + wide))
    close = F.col("along").between(F.col("lo") - near, F.col("hi") + near)
    sides = {}
    for name, ok in (("n", close), ("w", F.lit(True))):
        for o in ("h", "v"):
            sides[f"{name}{o}0"] = F.max(F.when(ok & (F.col("o") == o) & (F.col("pos") <= F.col("at")), F.col("pos")))
            sides[f"{name}{o}1"] = F.min(F.when(ok & (F.col("o") == o) & (F.col("pos") >= F.col("at")), F.col("pos")))
    found = points.select("page_id", "item_id").join(met.groupBy("page_id", "item_id").agg(*[c.alias(k) for k, c in sides.items()]), ["page_id", "item_id"], "left")
    box = lambda k, name, border: F.struct(
        F.lit(k).alias("try_no"), *[F.coalesce(F.col(name + side), F.lit(b) if border else F.lit(None).cast("int")).alias(c) for side, c, b in (("v0", "x1", 0), ("h0", "y1", 0), ("v1", "x2", page_w - 1), ("h1", "y2", page_h - 1))]
    )
    fits = lambda t: (t["x2"] - t["x1"]).between(params.cell_min_w, params.cell_max_w) & (t["y2"] - t["y1"]).between(params.cell_min_h, params.cell_max_h)
    tries = F.filter(F.array(box(1, "n", False), box(2, "w", False), box(3, "w", True)), lambda t: F.coalesce(fits(t), F.lit(False)))
    return found.select("page_id", "item_id", F.get(tries, 0).alias("t")).filter("t IS NOT NULL").select("page_id", "item_id", "t.*")


def near_duplicates(items: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs of items of one page whose boxes agree: page_id, a, b (a < b) and iou."""
    cols = ["page_id", "item_id", *BOX]
    pairs = overlapping(items.select(*cols), items.select(*cols))
    pairs = pairs.filter("a_item_id < b_item_id").withColumn("iou", g.iou(g.box("a_"), g.box("b_")))
    return pairs.filter(F.col("iou") >= params.dedup_iou).select("page_id", F.col("a_item_id").alias("a"), F.col("b_item_id").alias("b"), "iou")


def aligned_below(a, b, strict: bool) -> Column:
    """Whether box b may be the next line of a paragraph whose last line is a."""
    left = F.abs(a[0] - b[0])
    centre = F.abs(g.centre_x(a) - g.centre_x(b))
    right = F.abs(a[2] - b[2])
    shared = g.overlap_x(a, b)
    widest = F.greatest(g.width(a), g.width(b), F.lit(1))
    if strict:
        return (left <= 24) | (centre <= 36) | ((shared > 0) & (shared / widest > 0.55))
    return (left < 60) | (centre < 80) | (right < 60) | (shared / widest > 0.4)


def nearest_below(items: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, item_id, below and v_gap: the nearest aligned line under each item.

    The gap is bounded by a multiple of both heights, so a box's share of the space below it and a box's share of the space
    above it must touch: these spaces meet by square.
    """
    cols = ["page_id", "item_id", *BOX]
    a, b = g.box("a_"), g.box("b_")
    v_gap = b[1] - a[3]
    most, aside = (1.2, 36) if strict else (2.5, 80)
    one = F.lit(1)
    tall = lambda x: F.greatest(one, g.height(x)) if strict else g.height(x)
    space = lambda x: F.ceil(tall(x) * most / 2).cast("int")
    under = squares(prefixed(items.select(*cols), "a_", ()).withColumns({"u_x1": a[0] - aside, "u_y1": a[3], "u_x2": a[2] + aside, "u_y2": a[3] + space(a)}), "u_")
    above = squares(prefixed(items.select(*cols), "b_", ()).withColumns({"o_x1": b[0], "o_y1": b[1] - space(b), "o_x2": b[2], "o_y2": b[1]}), "o_").withColumnsRenamed({"gx": "b_gx", "gy": "b_gy"})
    near = (F.col("a_page_id") == F.col("b_page_id")) & (F.col("gx") == F.col("b_gx")) & (F.col("gy") == F.col("b_gy"))
    pairs = under.join(above, near & (F.col("a_item_id") != F.col("b_item_id")) & (v_gap >= 0) & (v_gap <= most * ((tall(a) + tall(b)) / 2)) & aligned_below(a, b, strict))
    best = pairs.groupBy(F.col("a_page_id").alias("page_id"), F.col("a_item_id").alias("item_id")).agg(F.min(F.struct(v_gap.alias("v_gap"), F.col("b_item_id").alias("below"))).alias("m"))
    return best.select("page_id", "item_id", "m.below", "m.v_gap")


def crossed_by_lines(items: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id, item_id and the sorted distinct positions of lines that run through an item's inside."""
    b = lines.select(F.col("page_id").alias("b_page"), "pos")
    met = items.select("page_id", "item_id", *BOX).join(b, (F.col("page_id") == F.col("b_page")) & (F.col("pos") > F.col("y1")) & (F.col("pos") < F.col("y2")))
    return met.groupBy("page_id", "item_id").agg(F.array_sort(F.collect_set("pos")).alias("lines"))


def cut_crossings(items: DataFrame, cuts: DataFrame) -> DataFrame:
    """page_id and the number of items that a cut runs through; each item counts once."""
    b = cuts.select(F.col("page_id").alias("b_page"), "orient", "pos")
    through = F.when(F.col("orient") == "h", (F.col("y1") < F.col("pos")) & (F.col("pos") < F.col("y2"))).otherwise((F.col("x1") < F.col("pos")) & (F.col("pos") < F.col("x2")))
    met = items.join(b, (F.col("page_id") == F.col("b_page")) & through, "left_semi")
    return met.groupBy("page_id").agg(F.count(F.lit(1)).alias("crossed"))


def nested_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of cells that overlap by more than 70 % of the smaller: the larger stays, of equals the first by top and left."""
    cols = ["page_id", *BOX]
    p = overlapping(cells.select(*cols).distinct(), cells.select(*cols).distinct())
    a, b = g.box("a_"), g.box("b_")
    first = (g.area(a) > g.area(b)) | ((g.area(a) == g.area(b)) & (F.struct("a_y1", "a_x1", "a_y2", "a_x2") < F.struct("b_y1", "b_x1", "b_y2", "b_x2")))
    return p.filter(first & (g.overlap_area(a, b) > 0.7 * F.least(g.area(a), g.area(b))))

"""Tiles of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.greedy import gap_cuts
from ..params import DEFAULT
from .paging import by_page, dealt

#: Pixels around an item in which nothing is cut.
CUT_MARGIN = 30


def overlapping_tiles(pages: DataFrame, tile: int = DEFAULT.tile, overlap: int = DEFAULT.tile_overlap) -> DataFrame:
    """page_id, x, y, w, h: tiles that overlap; the last of a row or column is moved back to its full size, so some coincide and are given once."""
    step = max(1, tile - overlap)

    def starts(total: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(1), total) - 1, F.lit(step))
        return F.array_distinct(F.transform(at, lambda s: F.greatest(F.lit(0), F.least(total, s + tile) - tile)))

    rows = pages.select("page_id", "page_w", "page_h", F.explode(starts(F.col("page_w"))).alias("x")).select("page_id", "page_w", "page_h", "x", F.explode(starts(F.col("page_h"))).alias("y"))
    return rows.select("page_id", "x", "y", F.least(F.lit(tile), F.col("page_w") - F.col("x")).alias("w"), F.least(F.lit(tile), F.col("page_h") - F.col("y")).alias("h"))


def grid_tiles(pages: DataFrame, tile: int, least: int = 0) -> DataFrame:
    """page_id, x, y, w, h: tiles side by side; those narrower or lower than ``least`` are left out."""
    at = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), c) - 1, F.lit(tile)))
    rows = pages.select("page_id", "page_w", "page_h", at(F.col("page_w")).alias("x")).select("page_id", "page_w", "page_h", "x", at(F.col("page_h")).alias("y"))
    out = rows.select("page_id", "x", "y", F.least(F.lit(tile), F.col("page_w") - F.col("x")).alias("w"), F.least(F.lit(tile), F.col("page_h") - F.col("y")).alias("h"))
    return out.filter((F.col("w") >= least) & (F.col("h") >= least))


def axis_cuts(items: DataFrame, pages: DataFrame, axis: str, total: int | str, target: int, margin: int = CUT_MARGIN, least: int = DEFAULT.min_gap) -> DataFrame:
    """page_id, orient and pos: cuts of one axis (x or y) in the gaps between items, evenly where gaps do not suffice.

    ``total`` is the size of all pages, or the column of ``pages`` that has it. Items and pages are dealt once, as narrow rows of
    one table, and a page's gaps and their greedy choice are one call; pages whose items leave no gap have no cut.
    """
    size = F.lit(total) if isinstance(total, int) else F.col(total)
    sizes = pages.select("page_id", F.lit(0).alias("a"), F.lit(0).alias("b"), size.cast("int").alias("total")).filter("total IS NOT NULL").distinct()
    spans = items.select("page_id", F.greatest(F.lit(0), F.col(f"{axis}1") - margin).cast("int").alias("a"), F.coalesce(F.col(f"{axis}2") + margin, F.lit(2**31 - 1)).cast("int").alias("b"), F.lit(-1).alias("total"))

    def choose(rows: list) -> list[tuple]:
        end = max(r.total for r in rows)
        cuts = gap_cuts([(int(r.a), int(r.b)) for r in rows if r.total < 0], int(end), target, least)
        return [(rows[0].page_id, "v" if axis == "x" else "h", c) for c in cuts]

    return by_page(spans.unionByName(sizes), choose, "page_id bigint, orient string, pos int")


def smart_tiles(items: DataFrame, pages: DataFrame, page_w: int | None, page_h: int | None, target: int, plain_below: int = 1280) -> DataFrame:
    """page_id, x, y, w, h: tiles between the cuts of both axes; small pages stay whole, pages without items get a plain grid.

    Without ``page_w`` and ``page_h`` each page has its own size, in columns of these names.
    """
    sized = pages if page_w is None else pages.withColumns({"page_w": F.lit(page_w), "page_h": F.lit(page_h)})
    sized = sized.select("page_id", F.col("page_w").cast("int").alias("page_w"), F.col("page_h").cast("int").alias("page_h")).distinct()
    small = F.greatest("page_w", "page_h") <= plain_below
    whole = sized.filter(small).select("page_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("page_w").alias("w"), F.col("page_h").alias("h"))
    large = sized.filter(~small)
    seen = dealt(items.select("page_id"), "page_id").distinct()
    used, empty = large.join(seen, "page_id", "left_semi"), large.join(seen, "page_id", "left_anti")

    def edges(axis: str, total: str) -> DataFrame:
        cuts = dealt(axis_cuts(items, used, axis, total, target), "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list("pos")).alias("cuts"))
        all_edges = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.col(total)))
        e = used.join(cuts, "page_id", "left").select("page_id", all_edges.alias("e"))
        pairs = F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("a"), F.slice("e", 2, F.size("e") - 1).alias("b"))
        return e.select("page_id", F.explode(pairs).alias("p")).select("page_id", F.col("p.a").alias(axis), (F.col("p.b") - F.col("p.a")).alias("w" if axis == "x" else "h"))

    tiles = edges("x", "page_w").join(edges("y", "page_h"), "page_id").select("page_id", "x", "y", "w", "h")
    return whole.unionByName(tiles).unionByName(grid_tiles(empty, target).select("page_id", "x", "y", "w", "h"))

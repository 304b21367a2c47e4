"""Aggregates of items, blocks and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .sequences import numbered
from .translate import is_translated

UNION_BOX = [F.min, F.min, F.max, F.max]


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates of the box around a group."""
    return [f(prefix + c).alias(c) for f, c in zip(UNION_BOX, ("x1", "y1", "x2", "y2"), strict=True)]


def coverage(items: DataFrame, keys: list[str]) -> DataFrame:
    """total, translated, untranslated and the box around each group."""
    done = F.count_if(is_translated())
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), done.alias("translated"), (F.count(F.lit(1)) - done).alias("untranslated"), *union_box())


def confidence_bands(items: DataFrame, keys: list[str], high: float = 0.9, low: float = 0.7) -> DataFrame:
    """high, middle and rest: items by band of confidence. With high = low there are two bands."""
    c = F.coalesce("confidence", F.lit(0.0))
    return items.groupBy(*keys).agg(F.count_if(c >= high).alias("high"), F.count_if((c >= low) & (c < high)).alias("middle"), F.count_if(c < low).alias("rest"))


def blocks(items: DataFrame, keys: list[str], default_confidence: float | None = 1.0, more: dict[str, Column] | None = None) -> DataFrame:
    """Items of one group as one block: texts joined by line breaks in order of y, boxes, mean confidence and sources; ``more`` names further aggregates."""
    more = more or {}
    row = F.struct(F.col("y1").alias("k"), F.col("item_id").alias("i"), "text", "x1", "y1", "x2", "y2")
    confidence = F.col("confidence") if default_confidence is None else F.coalesce("confidence", F.lit(default_confidence))
    # Summed as whole millionths: the mean does not depend on the order in which rows arrive.
    mean = F.sum(F.round(confidence * 1_000_000).cast("bigint")).cast("double") / F.count(confidence) / F.lit(1_000_000.0)
    g = items.groupBy(*keys).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.round(mean, 3).alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"), *union_box(),
        *[c.alias(name) for name, c in more.items()],
    )
    return g.select(
        *keys,
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"),
        "x1", "y1", "x2", "y2", "confidence", "source",
        F.size("rows").alias("n_lines"),
        F.transform("rows", lambda r: r["text"]).alias("sub_texts"),
        F.transform("rows", lambda r: F.struct(r["x1"].alias("x1"), r["y1"].alias("y1"), r["x2"].alias("x2"), r["y2"].alias("y2"))).alias("sub_bboxes"),
        *more,
    )


def table_region(cells: DataFrame, page_w: int, page_h: int, least: int = 3, margin: float = 0.2) -> DataFrame:
    """The region of a page's cells widened by a fifth on every side, inside the page; pages of fewer than three cells have none."""
    g = cells.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), *union_box()).filter(F.col("n") >= least)
    dx, dy = F.floor((F.col("x2") - F.col("x1")) * margin).cast("int"), F.floor((F.col("y2") - F.col("y1")) * margin).cast("int")
    return g.select(
        "page_id", "n", F.greatest(F.lit(0), F.col("x1") - dx).alias("x1"), F.greatest(F.lit(0), F.col("y1") - dy).alias("y1"), F.least(F.lit(page_w), F.col("x2") + dx).alias("x2"), F.least(F.lit(page_h), F.col("y2") + dy).alias("y2")
    )


def ruling_extents(segments: DataFrame) -> DataFrame:
    """First start and last end of the segments at each position."""
    return segments.groupBy("page_id", "orient", "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))


def named_cells(cells: DataFrame) -> DataFrame:
    """Cells with cell_no and cell_id in order of top and left on their page."""
    return numbered(cells, ["page_id"], ["y1", "x1", "y2", "x2"], "cell_no").withColumn("cell_id", t.cell_id(F.col("cell_no")))


def cell_report(cells: DataFrame, assigned: DataFrame) -> DataFrame:
    """page_id, cell_id, cell_no, n_texts, multi and preview of every cell; ``assigned`` has the cell's box as c_ columns, text and item_id."""
    c = named_cells(cells)
    a = assigned.select(F.col("page_id").alias("__p"), *[f"c_{k}" for k in ("x1", "y1", "x2", "y2")], "item_id", "text")
    same = (F.col("page_id") == F.col("__p")) & (F.col("x1") == F.col("c_x1")) & (F.col("y1") == F.col("c_y1")) & (F.col("x2") == F.col("c_x2")) & (F.col("y2") == F.col("c_y2"))
    g = c.join(a, same, "left").groupBy("page_id", "cell_id", "cell_no").agg(F.count("item_id").alias("n_texts"), F.min(F.struct("item_id", "text")).alias("m"))
    return g.select("page_id", "cell_id", "cell_no", "n_texts", (F.col("n_texts") > 1).alias("multi"), t.truncated(F.col("m.text"), 60).alias("preview"))


def merge_counters(assigned: DataFrame, items: DataFrame) -> DataFrame:
    """Per page: items, cells with text, cells with several texts, and items without a cell."""
    a = assigned.groupBy("page_id", "c_x1", "c_y1", "c_x2", "c_y2").agg(F.count(F.lit(1)).alias("k"))
    a = a.groupBy(F.col("page_id").alias("__p")).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("k") > 1).alias("groups"), F.sum("k").alias("inside"))
    n = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"))
    met = n.join(a, F.col("page_id") == F.col("__p"), "left")
    zero = F.lit(0).cast("bigint")
    return met.select("page_id", "total", F.coalesce("cells", zero).alias("cells"), F.coalesce("groups", zero).alias("groups"), (F.col("total") - F.coalesce("inside", zero)).alias("unassigned"))


def routes(items: DataFrame, keys: list[str], route: Column) -> DataFrame:
    """Items by the way they are put back, one column a way; they add up to the total."""
    ways = ("horizontal", "vertical", "rotated", "split", "skipped")
    return items.withColumn("__r", route).groupBy(*keys).agg(*[F.count_if(F.col("__r") == w).alias(w) for w in ways], F.count(F.lit(1)).alias("total"))


def wrapped_extent(lines: Column, advance: float, line_height: float, spacing: float) -> dict[str, Column]:
    """Width of the widest line and height of all lines with the spacing between them."""
    return {
        "max_w": F.array_max(F.transform(lines, lambda x: F.char_length(x))) * advance,
        "total_h": F.size(lines) * line_height + F.greatest(F.lit(0), F.size(lines) - 1) * spacing,
    }

"""Whole flows: the operators in the order in which a document passes through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..functions.fitting import Metrics, TableMetrics
from ..operators import aggregates, fitting, grouping, items, raster, sequences, spatial, translate
from ..params import DEFAULT, Params
from ..session import stored


def intersection_grid(segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cells from line segments: lines merged within reach, kept if crossed often enough, paired to cells, and closed on three sides at least."""
    return grouping.enclosed_cells(items.segment_kind(segments), params)


def text_gap_cells(texts: DataFrame, cells: DataFrame, page_w: int, page_h: int, params: Params = DEFAULT) -> DataFrame:
    """Cells between the medians of clustered text edges, inside the region of the cells that are known. The texts inside are stored: each of their four edges is a step."""
    region = aggregates.table_region(cells, page_w, page_h).select(F.col("page_id").alias("__p"), *[F.col(c).alias(f"r_{c}") for c in spatial.BOX])
    inside = stored(texts.join(region, (F.col("page_id") == F.col("__p")) & g.contains(g.box("r_"), g.box())).select("page_id", *spatial.BOX))
    edges = None
    for orient, lo, hi, tolerance in (("v", "x1", "x2", 25), ("h", "y1", "y2", 20)):
        found = None
        for c in (lo, hi):
            m = sequences.cluster_medians(inside.select("page_id", c), ["page_id"], c, tolerance).select("page_id", F.lit(orient).alias("orient"), F.col("median").alias("pos"))
            found = m if found is None else found.unionByName(m)
        edges = found if edges is None else edges.unionByName(found)
    return spatial.grid_cells(edges.distinct(), params)


def cell_cascade(stages: dict[str, DataFrame], texts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cells of all stages as one set, without cells inside morphological ones (stage M) or larger ones, near text and in a grid, numbered by top and left.

    Stages (62 at most) are bits of one number on the way. What two steps read is stored, once for all stages and once for cells near text.
    """
    names = sorted(stages)
    every = None
    for k, name in enumerate(names):
        one = items.cell_gate(stages[name].select("page_id", *spatial.BOX), params).withColumn("bits", F.lit(1 << k).cast("bigint"))
        every = one if every is None else every.unionByName(one)
    has = lambda name: F.col("bits").bitwiseAND(F.lit(1 << names.index(name)).cast("bigint")) != 0
    # In order of pages, boxes are packed to a few bytes a row. Spark then takes them for few: it is to sort both sides.
    ordered = lambda df: df.sortWithinPartitions("page_id", "y1", "x1")
    union = stored(ordered(every.groupBy("page_id", *spatial.BOX).agg(F.bit_or("bits").alias("bits")))).withColumn("morph", has("M") if "M" in names else F.lit(False)).hint("merge")
    kept = spatial.outermost(union).drop("morph").hint("merge")
    near = stored(ordered(spatial.cells_near_text(kept, texts, params, unique=True))).hint("merge")
    kept = spatial.grid_neighbours(near, params, unique=True)
    told = F.array_join(F.array_compact(F.array(*[F.when(has(name), F.lit(name)) for name in names])), ",")
    return aggregates.named_cells(kept).select("page_id", *spatial.BOX, told.alias("stages"), "cell_no", "cell_id")


def scanned_cells(rasters: DataFrame, texts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The cascade on images: enclosed regions (M), contours (A) and the grid of line segments (B) of each page.

    What detectors find is stored: images are looked at once.
    """
    cells, contours, segments = raster.detected_by_all(rasters, params)
    return cell_cascade({"M": cells, "A": items.contour_gate(contours, params), "B": intersection_grid(segments, params)}, texts, params)


def dispatched_cells(preferred: DataFrame | None, fallback: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Each page's cells by the preferred engine, or by the other one where that gives fewer than least_cells or is not there; engine tells which."""
    second = fallback.select("page_id", *spatial.BOX).withColumn("engine", F.lit("fallback"))
    if preferred is None:
        return second
    first = preferred.select("page_id", *spatial.BOX)
    enough = first.groupBy("page_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= params.least_cells).select(F.col("page_id").alias("__p"))
    on = F.col("page_id") == F.col("__p")
    return first.join(enough, on, "left_semi").withColumn("engine", F.lit("preferred")).unionByName(second.join(enough, on, "left_anti"))


def translated(blocks: DataFrame, terms: DataFrame, cache: DataFrame, translator: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """Dictionary, then cache, then the translator over the distinct texts that are left."""
    hit, left = translate.cache_cascade(translate.with_terms(blocks, terms), cache)
    hit = hit.drop("hit")
    if translator is None:
        return hit.withColumn("translated", F.coalesce("translated", "text"))
    fresh = translate.translated_texts(left, translator).select(F.col("text").alias("__t"), F.col("translated").alias("__new"))
    return hit.join(fresh, F.col("text") == F.col("__t"), "left").withColumn("translated", F.coalesce("translated", "__new", "text")).drop("__t", "__new")


def unified_flow(found: DataFrame, terms: DataFrame, cache: DataFrame, translator=None, script: str | None = t.HAN, metrics: Metrics | TableMetrics = Metrics(), params: Params = DEFAULT) -> DataFrame:
    """Recognised items to placed lines: gate, near-duplicates, paragraphs of upright items, translation, and one row a line in its own or the whole box.

    Lines are numbered anew on each page, in the order of their blocks. Turned items are blocks of their own.
    """
    kept = grouping.deduplicated(items.gated(found, script, params), params)
    done = translated(grouping.merged_lines(kept, True, params), terms, cache, translator)
    lines = fitting.line_boxes(done.filter(translate.is_translated()))
    ready = sequences.numbered(lines, ["page_id"], ["chain", "line_no"], "item_id").withColumns({"size": F.greatest(F.lit(4.0), (F.col("y2") - F.col("y1")) * 0.92)})
    return fitting.fitted_lines(ready, metrics, unified=True)


def vector_flow(spans: DataFrame, terms: DataFrame, script: str = t.HAN, metrics: Metrics | TableMetrics = Metrics()) -> DataFrame:
    """Vector text items to their way back: every term replaced, too tall vertical texts shortened, route and erase decided."""
    out = translate.short_terms(translate.replace_terms(spans, terms), terms, metrics)
    fits = fitting.single_line(metrics)
    # The fit is that of the translation, so it is measured on it.
    split = out.withColumnRenamed("text", "source_text").withColumnRenamed("translated", "text").withColumns(fits).withColumnRenamed("text", "translated").withColumnRenamed("source_text", "text")
    words = F.size(F.split(F.trim("translated"), r"\s+"))
    routed = split.withColumn("needs_split", (F.col("fit_state") == "wrap") & (words > 1))
    return routed.withColumns({"route": translate.refill_route(script), "erase": F.lit(True)}).drop("fit_state", "fit_size")

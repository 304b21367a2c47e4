"""Raster pages (binary grey values with width and height) through numpy kernels, a batch of pages at a time."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, raster
from ..params import DEFAULT, Params
from ..session import stored
from .paging import by_page

#: Bytes of pages handed to a Python worker at once: a scanned page has some megabytes.
BATCH_BYTES = 16 << 20
#: Found rows that a task keeps for images that come again.
REMEMBERED = 200_000


def image_of(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most, or one row; a smaller limit of the session stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf
    if conf.get(key, None) is None or int(conf.get(key).rstrip("b")) > BATCH_BYTES or int(conf.get(key).rstrip("b")) <= 0:
        conf.set(key, str(BATCH_BYTES))


def once_an_image(kernel: Callable[[np.ndarray], list[tuple]], most: int = REMEMBERED) -> Callable[[bytes, int, int], list[tuple]]:
    """``kernel`` for pixels, width and height; what it found is kept while it is ``most`` rows in all, so equal images are looked at once."""
    known: dict[tuple[bytes, int, int], list[tuple]] = {}
    held = 0

    def look(pixels: bytes, width: int, height: int) -> list[tuple]:
        nonlocal held
        key = (blake2b(pixels, digest_size=32).digest(), width, height)
        if key not in known:
            found = kernel(image_of(pixels, width, height))
            if held + len(found) + 1 > most:
                known.clear()
                held = 0
            known[key] = found
            held += len(found) + 1
        return known[key]

    return look


#: What kernels found, by a name for each with its limits: a Python worker keeps it for its next tasks.
_looks: dict[tuple, Callable[[bytes, int, int], list[tuple]]] = {}


def once_a_worker(kernel: Callable[[np.ndarray], list[tuple]], key: tuple) -> Callable[[bytes, int, int], list[tuple]]:
    """``once_an_image`` for all tasks of a worker; the memories of eight keys stay."""
    if key not in _looks:
        if len(_looks) >= 8:
            _looks.pop(next(iter(_looks)))
        _looks[key] = once_an_image(kernel)
    return _looks[key]


def on_pages(rasters: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str, key: tuple | None = None) -> DataFrame:
    """The rows that ``kernel`` finds on each page's image, after its page_id; a page without an image has none.

    ``key`` tells what the kernel and its limits are; without one, what it found is kept for a task only.
    """
    names = ["page_id", *[c.strip().split()[0] for c in schema.split(",")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = once_an_image(kernel) if key is None else once_a_worker(kernel, key)
        for frame in frames:
            out = [(r.page_id, *x) for r in frame.itertuples(index=False) for x in look(r.pixels, int(r.width), int(r.height))]
            made = pd.DataFrame(out, columns=names)
            made["page_id"] = made.page_id.astype("Int64")
            yield made

    bounded_batches(rasters.sparkSession)
    there = rasters.filter("pixels IS NOT NULL AND width > 0 AND height > 0")
    return there.select("page_id", "width", "height", "pixels").mapInPandas(run, f"page_id bigint, {schema}")


def packed(rasters: DataFrame) -> DataFrame:
    """page_id, width, height and deflated pixels of rasters that are there: what is dealt and sorted is a fraction of the pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(packed=[zlib.compress(p, 1) for p in frame.pixels]).drop(columns="pixels")

    bounded_batches(rasters.sparkSession)
    there = rasters.filter("page_id IS NOT NULL AND pixels IS NOT NULL AND width > 0 AND height > 0")
    return there.select("page_id", "width", "height", "pixels").mapInPandas(run, "page_id bigint, width int, height int, packed binary")


def unpacked(row) -> np.ndarray:
    return image_of(zlib.decompress(row.packed), int(row.width), int(row.height))


def chosen(rows: list) -> np.ndarray | None:
    """The image of a page's packed rasters that counts: the widest, then the highest, then the last by its pixels."""
    size = max(((r.width, r.height) for r in rows), default=None)
    different = {r.packed: r for r in rows if (r.width, r.height) == size}
    return max((unpacked(r) for r in different.values()), key=lambda i: i.tobytes()) if len(different) > 1 else next(map(unpacked, different.values()), None)


def on_items(items: DataFrame, rasters: DataFrame, kernel: Callable[[list, np.ndarray | None], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` gets the items of a page and the page's image, None without one, and returns output rows; rows without a page have none.

    Items and packed rasters are dealt and sorted as one table, many pages a batch.
    """
    numbers = {"byte", "short", "integer", "long"}  # a null would make the column one of doubles
    blank = [(F.lit(0) if f.dataType.typeName() in numbers else F.lit(None)).cast(f.dataType).alias(f.name) for f in items.schema if f.name != "page_id"]
    own = items.select("*", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(None).cast("binary").alias("packed"))
    images = packed(rasters).select("page_id", *blank, "width", "height", "packed")

    def run(rows: list) -> list[tuple]:
        left = [r for r in rows if r.packed is None]
        return kernel(left, chosen([r for r in rows if r.packed is not None])) if left else []

    return by_page(own.unionByName(images), run, schema)


SEGMENT = "item_id bigint, x1 int, y1 int, x2 int, y2 int"
CONTOUR = "x1 int, y1 int, x2 int, y2 int, contour_area double, corners int, white_ratio double"
CELL = "x1 int, y1 int, x2 int, y2 int, white_ratio double"


def segments_of(image: np.ndarray, params: Params) -> list[tuple]:
    edge = detect.edges(raster.ink(image).astype(np.uint8) * 255)
    return [(k, *s) for k, s in enumerate(detect.line_segments(edge, params.hough_votes, params.hough_length, params.hough_gap))]


def contours_of(image: np.ndarray, params: Params) -> list[tuple]:
    mask = detect.closed(raster.locally_dark(image, 31, 8))
    out = []
    for box, area, corners in detect.outer_contours(mask, params.cell_min_w, params.cell_min_h):
        white = raster.white_share(image, box, level=params.white_level)
        if white is not None:
            out.append((*box, area, corners, white))
    return out


def cells_of(image: np.ndarray, params: Params) -> list[tuple]:
    out = []
    for box in raster.cells_by_components(image, min_area=params.component_min_area, max_share=params.component_max_share, max_aspect=params.component_max_aspect):
        white = raster.white_share(image, box, level=params.white_level)
        if white is not None:
            out.append((*box, white))
    return out


def fitting_contours(found: DataFrame, params: Params) -> DataFrame:
    return found.filter(((F.col("x2") - F.col("x1")) <= params.cell_max_w) & ((F.col("y2") - F.col("y1")) <= params.cell_max_h))


def fitting_cells(found: DataFrame, params: Params) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return found.filter(w.between(params.cell_min_w, params.cell_max_w) & h.between(params.cell_min_h, params.cell_max_h) & (F.col("white_ratio") >= params.white_share))


def detected_segments(rasters: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """page_id, item_id (a number on the page), x1, y1, x2, y2 of the line segments on each page: edges of the ink, then a Hough search."""
    return on_pages(rasters, lambda image: segments_of(image, params), SEGMENT, ("segments", params))


def detected_contours(rasters: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """page_id, x1, y1, x2, y2, contour_area, corners, white_ratio of outer contours within the size limits of cells."""
    return fitting_contours(on_pages(rasters, lambda image: contours_of(image, params), CONTOUR, ("contours", params)), params)


def detected_cells(rasters: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """page_id, x1, y1, x2, y2, white_ratio of the cells that lines enclose, within the size limits and white inside."""
    return fitting_cells(on_pages(rasters, lambda image: cells_of(image, params), CELL, ("cells", params)), params)


def detected_by_all(rasters: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``detected_cells``, ``detected_contours`` and ``detected_segments``: pages are made, handed over and looked at once for all three, and what is found is stored."""
    kinds = {"cell": (CELL, cells_of), "contour": (CONTOUR, contours_of), "segment": (SEGMENT, segments_of)}
    every = {c.split()[0]: c for schema, _ in kinds.values() for c in schema.split(", ")}
    places = {kind: [c.split()[0] for c in schema.split(", ")] for kind, (schema, _) in kinds.items()}

    def kernel(image: np.ndarray) -> list[tuple]:
        out = []
        for kind, (_, look) in kinds.items():
            for x in look(image, params):
                row = dict(zip(places[kind], x, strict=True))
                out.append((kind, *[row.get(c, 0) for c in every]))  # no nulls, which would make columns of doubles
        return out

    found = stored(on_pages(rasters, kernel, ", ".join(["kind string", *every.values()]), ("all", params)))
    cells, contours, segments = (found.filter(F.col("kind") == kind).select("page_id", *names) for kind, names in places.items())
    return fitting_cells(cells, params), fitting_contours(contours, params), segments


def detected_lines(rasters: DataFrame, length: int = 80) -> DataFrame:
    """page_id, orient, pos, lo, hi of long dark lines."""

    return on_pages(rasters, lambda image: raster.ruling_lines(image, length), "orient string, pos int, lo int, hi int")


def one_a_page(rasters: DataFrame) -> DataFrame:
    """page_id, width, height and pixels of one raster a page: of several, the widest, then the highest, then the last by its pixels."""

    def kernel(rows: list) -> list[tuple]:
        image = chosen(rows)
        return [(rows[0].page_id, image.shape[1], image.shape[0], image.tobytes())]

    return by_page(packed(rasters), kernel, "page_id bigint, width int, height int, pixels binary")


def measured(items: DataFrame, rasters: DataFrame) -> DataFrame:
    """Append mean_level and white_ratio of each item's box on its page's raster; items of pages without one have no row."""

    def kernel(rows: list, image: np.ndarray | None) -> list[tuple]:
        if image is None:
            return []
        boxes = [(int(a.x1), int(a.y1), int(a.x2), int(a.y2)) for a in rows]
        return [(a.page_id, a.item_id, raster.mean_level(image, b), raster.white_share(image, b)) for a, b in zip(rows, boxes, strict=True)]

    return on_items(items.select("page_id", "item_id", "x1", "y1", "x2", "y2"), rasters, kernel, "page_id bigint, item_id bigint, mean_level double, white_ratio double")


def closed_cells(cells: DataFrame, rasters: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cells with two dark corners at least and white inside; ``cells`` has sides: with three, corners are looked for in a wider square.

    The white limit is 0.85 of that for other cells, since cells full of text are darker. Pages without a raster have none.
    """

    def kernel(rows: list, image: np.ndarray | None) -> list[tuple]:
        out = []
        for c in rows if image is not None else []:
            box = (int(c.x1), int(c.y1), int(c.x2), int(c.y2))
            white = raster.white_share(image, box, level=params.white_level)
            if raster.dark_corners(image, box, 10 if c.sides == 3 else 6, params.corner_level) >= 2 and white is not None and white >= 0.85 * params.white_share:
                out.append((c.page_id, *box, c.sides, white))
        return out

    a = cells.select("page_id", "x1", "y1", "x2", "y2", F.col("sides").cast("bigint").alias("sides"))
    return on_items(a, rasters, kernel, "page_id bigint, x1 int, y1 int, x2 int, y2 int, sides bigint, white_ratio double")

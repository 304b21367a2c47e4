"""Readers. Parsers and recognisers of outside formats are injected; nothing here needs an imaging or PDF library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster as kernels
from ..functions.greedy import page_tiles
from ..operators import grouping, items, raster, sequences, tiling
from ..operators.spatial import BOX
from ..params import DEFAULT, Params

ITEM = "text string, x1 int, y1 int, x2 int, y2 int, angle double, confidence double"


def terms(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of terms as rows in file order; a key that occurs twice gives two rows."""
    return terms_of(spark.read.text(path, wholetext=True)).select("ord", "cn", "en")


def terms_of(raw: DataFrame) -> DataFrame:
    """The same of every row's JSON object in ``value``; other columns stay. Null and empty objects have no terms."""
    pairs = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'), 0)
    rest = [c for c in raw.columns if c != "value"]
    rows = raw.select(*rest, F.posexplode(pairs).alias("ord", "pair"))
    one = F.from_json(F.concat(F.lit("{"), "pair", F.lit("}")), "map<string,string>")
    return rows.select(*rest, "ord", F.map_keys(one)[0].alias("cn"), F.map_values(one)[0].alias("en"))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """A translation cache: a JSON object of texts."""
    return cache_of(spark.read.text(path, wholetext=True)).select("text", "translated")


def cache_of(raw: DataFrame) -> DataFrame:
    """text and translated of every row's JSON object in ``value``; other columns stay."""
    rest = [c for c in raw.columns if c != "value"]
    return raw.select(*rest, F.explode(F.from_json("value", "map<string,string>")).alias("text", "translated"))


def as_mapping(result) -> dict:
    """What an engine returns as a dict: itself, its ``json`` attribute, or what that attribute returns when called."""
    if isinstance(result, dict):
        return result
    found = getattr(result, "json", None)
    found = found() if callable(found) else found
    return found if isinstance(found, dict) else {}


def json_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Extracted items from JSON arrays."""
    return spark.read.schema(schema).json(path, multiLine=True)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Documents as path, modificationTime, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def rendered(documents: DataFrame, render: Callable[[bytes], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    """path, page_no, width, height and pixels of every page by an injected renderer."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame([(r.path, *p) for p in render(r.content)], columns=["path", "page_no", "width", "height", "pixels"])

    return documents.select("path", "content").mapInPandas(kernel, "path string, page_no int, width int, height int, pixels binary")


def first_pages(documents: DataFrame, render: Callable[[bytes, int, float], tuple[float, float, int, int, int, bytes]], dpi: int = 200) -> DataFrame:
    """path, page_width_pt, page_height_pt, rotation, dpi, pixel_width, pixel_height and pixels of each document's first page.

    ``render`` gets the content, the page number 0 and the zoom, dpi / 72, and gives width and height in points, rotation,
    width and height in pixels, and pixels. A document without content has no row.
    """
    names = ["path", "page_width_pt", "page_height_pt", "rotation", "dpi", "pixel_width", "pixel_height", "pixels"]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):  # a frame a page: pages are large
                w, h, turn, pixel_w, pixel_h, pixels = render(r.content, 0, dpi / 72)
                yield pd.DataFrame([(r.path, w, h, turn, dpi, pixel_w, pixel_h, pixels)], columns=names)

    schema = "path string, page_width_pt double, page_height_pt double, rotation int, dpi int, pixel_width int, pixel_height int, pixels binary"
    return documents.filter("content IS NOT NULL").select("path", "content").mapInPandas(kernel, schema)


def recognised(tiles: DataFrame, engines: dict[str, Callable[[], Callable[[bytes, int, int], list[tuple]]]]) -> DataFrame:
    """Items of every tile by each engine, as one table with the engine as source; a tile that an engine fails on has none.

    Engines are made once a worker, when the first tile comes. Tiles have page_id, x, y, w, h and pixels.
    """

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {}
        for name, make in engines.items():
            try:
                made[name] = make()
            except Exception:  # noqa: BLE001  an engine that is not there is left out
                continue
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                for name, engine in made.items():
                    try:
                        found = engine(r.pixels, r.w, r.h)
                    except Exception:  # noqa: BLE001
                        continue
                    out += [(r.page_id, name, t, x1 + r.x, y1 + r.y, x2 + r.x, y2 + r.y, a, c) for t, x1, y1, x2, y2, a, c in found]
            yield pd.DataFrame(out, columns=["page_id", "source", "text", "x1", "y1", "x2", "y2", "angle", "confidence"])

    return tiles.mapInPandas(kernel, f"page_id bigint, source string, {ITEM}")


def recognised_tiles(tiles: DataFrame, engines: dict, page_w: int, page_h: int, script: str | None = None, params: Params = DEFAULT) -> DataFrame:
    """The whole chain over tiles: every engine's items, moved to the page, inside it, of the script and sure enough, numbered, and without near-duplicates.

    Numbers follow the page's reading order, so they do not depend on the order in which tiles are read.
    """
    found = items.clamp(recognised(tiles, engines), page_w, page_h).drop("width", "height")
    kept = items.gated(found, script, params)
    order = ["y1", "x1", "y2", "x2", "source", "text", "confidence"]
    return grouping.deduplicated(sequences.numbered(kept, ["page_id"], order, "item_id").withColumn("item_id", F.col("item_id").cast("bigint")), params, together=True)


Engine = Callable[[np.ndarray], list[tuple]]


def seen_twice(rasters: DataFrame, make: Callable[[], Engine], target: int, side: int, source: str = "fine") -> DataFrame:
    """Items that an engine finds on the tiles of each page, moved to the page and put inside it; the tiles are cut where a first look finds gaps.

    The first look is at the page made so small that no side is over ``side``. Both looks and the cuts between them are one
    call, so a page is made and handed over once and nothing is dealt. Pages that are small enough are one tile.
    """

    def first_look(engine: Engine, image: np.ndarray) -> list[tuple]:
        h, w = image.shape
        scale = side / max(w, h)
        small = kernels.shrunk(image, max(1, int(w * scale)), max(1, int(h * scale)))
        found = []
        for _, *box, _, _ in engine(small):
            x1, y1, x2, y2 = (int(v / scale) for v in box)
            x1, y1 = max(0, min(x1, w - 1)), max(0, min(y1, h - 1))
            found.append((x1, y1, max(x1 + 1, min(x2, w)), max(y1 + 1, min(y2, h))))
        return found

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                image = raster.image_of(r.pixels, int(r.width), int(r.height))
                h, w = image.shape
                seen = first_look(engine, image) if max(w, h) > side else []
                for x, y, tile_w, tile_h in page_tiles(seen, w, h, target, tiling.CUT_MARGIN, DEFAULT.min_gap, side):
                    for t, x1, y1, x2, y2, a, c in engine(image[y : y + tile_h, x : x + tile_w]):
                        out.append((r.page_id, source, t, x1 + x, y1 + y, x2 + x, y2 + y, float(a), float(c), w, h))
            yield pd.DataFrame(out, columns=["page_id", "source", "text", *BOX, "angle", "confidence", "page_w", "page_h"])

    raster.bounded_batches(rasters.sparkSession)
    there = rasters.filter("page_id IS NOT NULL AND pixels IS NOT NULL AND width > 0 AND height > 0")
    found = there.select("page_id", "width", "height", "pixels").mapInPandas(kernel, f"page_id bigint, source string, {ITEM}, page_w int, page_h int")
    return items.clamp(found, F.col("page_w"), F.col("page_h")).drop("width", "height", "page_w", "page_h")


def coarse_to_fine(rasters: DataFrame, make: Callable[[], Engine], target: int, side: int = 1280, script: str | None = None, params: Params = DEFAULT) -> DataFrame:
    """Items of pages seen twice: small and whole to find the gaps between texts, then tile by tile in full size.

    Tiles are cut in the gaps of the first look, each page by its own size; a page that is small enough is one tile, one
    without any text a plain grid. Items of the second look are gated, numbered in reading order and freed of near-duplicates.
    ``rasters`` has page_id (one row a page), width, height and pixels; ``make`` gives an engine from an image to
    (text, x1, y1, x2, y2, angle, confidence).
    """
    found = items.gated(seen_twice(rasters, make, target, side), script, params)
    order = ["y1", "x1", "y2", "x2", "text", "confidence"]
    numbered = sequences.numbered(found, ["page_id"], order, "item_id").withColumn("item_id", F.col("item_id").cast("bigint"))
    return grouping.deduplicated(numbered, params, together=True)

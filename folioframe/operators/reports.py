"""Reports as rows of text, ordered by line number, and the sums that go into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pdf_size(dpi: int) -> dict[str, Column]:
    """Page size in points of an image."""
    return {"width_pt": F.col("pixel_w") * 72.0 / dpi, "height_pt": F.col("pixel_h") * 72.0 / dpi}


def coarse_scale(side: int) -> Column:
    """The factor that brings the longer side down to ``side``; never above one."""
    return F.least(F.lit(1.0), F.lit(side) / F.greatest("pixel_w", "pixel_h"))


def report_lines(counts: DataFrame, title: str, rows: list[tuple[str, str]]) -> DataFrame:
    """A markdown table of one row of counts: line_no and line."""
    lines = [F.lit(f"# {title}"), F.lit(""), F.lit("| metric | value |"), F.lit("|---|---|")]
    lines += [F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |")) for label, c in rows]
    return counts.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def share(done: str, total: str) -> Column:
    """Percent with one decimal; null for an empty total."""
    return F.round(F.try_divide(F.col(done) * 100.0, F.col(total)), 1)


def cell_report_lines(report: DataFrame) -> DataFrame:
    """page_id, cell_no and the line that reports each cell."""
    text = F.when(F.col("n_texts") == 0, F.lit("(empty)")).otherwise(F.concat(F.col("n_texts").cast("string"), F.lit(" text(s): "), F.col("preview")))
    return report.select("page_id", "cell_no", F.concat("cell_id", F.lit(": "), text).alias("line"))


def overlay_colour(confidence: Column, bands: tuple[float, ...] = (0.9, 0.7)) -> Column:
    """Colour of a debug box by its band of confidence."""
    names = ("green", "orange", "red") if len(bands) == 2 else ("green", "red")
    out = F.when(confidence >= bands[0], names[0])
    for level, name in zip(bands[1:], names[1:]):
        out = out.when(confidence >= level, name)
    return out.otherwise(names[-1])

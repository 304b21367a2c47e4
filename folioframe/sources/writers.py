"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, characters as they are."""
    df.write.mode(mode).json(path)


def to_mapping(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """text to translation, a single-key JSON object a line."""
    df.select(F.to_json(F.create_map("text", F.coalesce("translated", "text"))).alias("value")).write.mode(mode).text(path)


def to_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report lines in order; reports are short."""
    lines.orderBy("line_no").select(F.col("line").alias("value")).coalesce(1).write.mode(mode).text(path)


def to_table(df: DataFrame, path: str, keys: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, by key folders where keys are given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)

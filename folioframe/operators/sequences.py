"""Window-like operators: runs, gaps, neighbours, shares and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULT


def clusters(points: DataFrame, keys: list[str], value: str, tolerance: int) -> DataFrame:
    """Append cluster (from 1): a new one where a value lies over ``tolerance`` beyond the one before."""
    there = points.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, value)))
    w = Window.partitionBy(*keys).orderBy(value)
    first = F.when(F.col(value) - F.lag(value).over(w) <= tolerance, 0).otherwise(1)
    # Equal values follow each other and end one frame, so they need no step of their own.
    return there.withColumn("__first", first).withColumn("cluster", F.sum("__first").over(w)).drop("__first")


def cluster_medians(points: DataFrame, keys: list[str], value: str, tolerance: int) -> DataFrame:
    """keys, cluster, n and the whole part of the median of each cluster's values."""
    return clusters(points, keys, value, tolerance).groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.floor(F.median(value)).cast("int").alias("median"))


def free_gaps(boxes: DataFrame, keys: list[str], lo: str, hi: str, total: int | str, margin: int = 30, least: int = DEFAULT.min_gap) -> DataFrame:
    """keys, gap_lo and gap_hi: stretches of 0..total (a number, or a column that the keys decide) that no box, widened by the margin, covers, ``least`` long at least."""
    end = F.col(total) if isinstance(total, str) else F.lit(total)
    spans = boxes.select(*keys, F.greatest(F.lit(0), F.col(lo) - margin).alias("a"), F.least(end, F.col(hi) + margin).alias("b")).filter("b > a")
    ends = boxes.select(*keys, end.alias("a")).distinct().withColumn("b", F.col("a"))
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.unionByName(ends).withColumn("gap_lo", F.coalesce(F.max("b").over(w), F.lit(0)))
    return seen.filter(F.col("a") - F.col("gap_lo") >= least).select(*keys, "gap_lo", F.col("a").alias("gap_hi"))


def next_lines(lines: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Each line with the next one: keys, pos, next and step."""
    nxt = F.lead(pos).over(Window.partitionBy(*keys).orderBy(pos))
    return lines.select(*keys, pos).distinct().withColumn("next", nxt).filter("next IS NOT NULL").withColumn("step", F.col("next") - F.col(pos))


def row_shares(rows: DataFrame, keys: list[str], height: str, total: Column) -> DataFrame:
    """Append share: each row's part of ``total`` by its height, 1 at least."""
    of = F.sum(height).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.greatest(F.lit(1), F.floor(F.col(height) * total / of)).cast("int"))


def y_cursor(rows: DataFrame, keys: list[str], order: list[str], height: str, start: str | None = None) -> DataFrame:
    """Append y: where each row starts when rows are stacked in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(height).over(w), F.lit(0))
    return rows.withColumn("y", before if start is None else before + F.col(start))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order: an exact, keep-first distinct. The rows travel as one combined minimum."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    m = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return m.select(*[F.col(c) if c in keys else F.col(f"m.{c}").alias(c) for c in df.columns])


def coordinate_runs(points: DataFrame, keys: list[str], value: str, gap: int = 4) -> DataFrame:
    """keys and the middle of each run of values no further apart than ``gap``."""
    return clusters(points, keys, value, gap).groupBy(*keys, "cluster").agg(F.floor((F.min(value) + F.max(value)) / 2).cast("int").alias("middle"))

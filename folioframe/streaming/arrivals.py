"""Files that arrive, and task states over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: str | StructType, most: int = 100) -> DataFrame:
    """Parquet files as they arrive, ``most`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def run_once(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process what has arrived, batch by batch, and stop; a batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(events: DataFrame, stamp: str = "ts", key: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows by key and time window; rows later than ``late`` are left out."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size), key).agg(F.count(F.lit(1)).alias("n"))


def live(events: DataFrame, stamp: str, days: int = 7) -> DataFrame:
    """Only the first row of each id within the days that state is kept."""
    return events.withWatermark(stamp, f"{days} days").dropDuplicatesWithinWatermark(["task_id"])

"""Tasks, uploads, results and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT

#: States that a task does not leave.
END_STATES = ("completed", "failed")


def accepted_uploads(files: DataFrame) -> DataFrame:
    """Files with a name that ends in .pdf in any case: base name and a fresh task id."""
    name = F.element_at(F.split(F.regexp_replace("path", r"\\", "/"), "/"), -1)
    return files.withColumn("filename", name).filter(F.lower("filename").endswith(".pdf")).withColumn("task_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))


def expired(rows: DataFrame, stamp: str, now: Column, days: int = DEFAULT.keep_days) -> DataFrame:
    """Rows older than the days before now."""
    return rows.filter(F.col(stamp) < now - F.expr(f"INTERVAL {days} DAYS"))


def result_listing(tasks: DataFrame) -> DataFrame:
    """task_id, file, path and description of every result of completed tasks, and the address to fetch it from."""
    rows = tasks.filter("status = 'completed'").select("task_id", F.explode(F.map_entries("result_files")).alias("e"))
    return rows.select("task_id", F.col("e.key").alias("file"), "e.value.path", "e.value.description", F.concat(F.lit("/api/download/"), F.col("task_id"), F.lit("/"), F.col("e.key")).alias("url"))


def status_of(tasks: DataFrame, task_id: str) -> DataFrame:
    """One task's state, or no row; text_count falls back to ocr_count."""
    return tasks.filter(F.col("task_id") == task_id).withColumn("text_count", F.coalesce("text_count", "ocr_count"))


def without_task(tasks: DataFrame, task_id: str) -> DataFrame:
    """All tasks but one."""
    return tasks.filter(~F.col("task_id").eqNullSafe(task_id))


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state of each task; a task that reached an end stays there, at its first end. Of equal times the smaller status counts."""
    end = F.when(F.col("status").isin(*END_STATES), F.struct("ts", "status"))
    last = F.max_by("status", F.struct("ts", F.transform(F.split("status", ""), lambda c: -F.ascii(c))))
    return changes.groupBy("task_id").agg(F.coalesce(F.min(end)["status"], last).alias("status"), F.max("ts").alias("ts"))

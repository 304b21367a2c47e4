"""The life of a task as a stream: what the log of its events says at any time, and its expiry.

A task is uploaded, processed, and then completed or failed for good; some days after its last event it expires. Events come
late, twice, and in any order. The state of a task is the sum of its events in which order does not matter (the first end and
the last event by time), so a replayed log ends in the states that ``operators.tasks.latest_states`` computes from the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.tasks import END_STATES
from ..params import DEFAULT

OUTPUT = "task_id string, status string, ts timestamp, version long"
STATE = "end_us long, end_status string, last_us long, last_status string, version long, due_ms long"
EXPIRED = "expired"
#: The store that keeps state of this kind.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(state: tuple | None, events: list[tuple[int, str]]) -> tuple:
    """(end time, end status, last time, last status) after more events (time, status); of equal times the smaller status."""
    ends = [e for e in events if e[1] in END_STATES] + ([state[:2]] if state and state[0] is not None else [])
    lasts = events + ([state[2:4]] if state else [])
    end = min(ends, default=(None, None))
    last = min(lasts, key=lambda e: (-e[0], e[1]))
    return (*end, *last)


def stamp(us: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=us)


class Lifecycle(StatefulProcessor):
    """One row a batch and task whose state has changed, with a version that grows; an expired task gives a last row and is forgotten."""

    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.state.get()
        version = had[4] if had else 0
        if had and had[5] <= timerValues.getCurrentWatermarkInMs():  # its time is over in this batch, so this is a new task
            self.handle.deleteTimer(had[5])
            version += 1
            yield self._row(key[0], EXPIRED, had[2], version)
            had = None
        events = [(int(us), status) for frame in rows for us, status in zip(frame.us, frame.status, strict=True)]
        now = merged(tuple(had[:4]) if had else None, events)
        due = now[2] // 1000 + self.keep_ms
        changed = not had or now != tuple(had[:4])
        if changed:
            if not had or had[5] != due:  # one timer a task: for its last event
                if had:
                    self.handle.deleteTimer(had[5])
                self.handle.registerTimer(due)
            version += 1
            self.state.update((*now, version, due))
            status = now[1] if now[0] is not None else now[3]
            yield self._row(key[0], status, now[2], version)

    @staticmethod
    def _row(task: str, status: str, us: int, version: int) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [task], "status": [status], "ts": [stamp(us)], "version": [version]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had = self.state.get()
        self.state.clear()
        if had:
            yield self._row(key[0], EXPIRED, had[2], had[4] + 1)

    def close(self) -> None:
        pass


def states(events: DataFrame, late: str = "1 hour", keep_days: int = DEFAULT.keep_days) -> DataFrame:
    """task_id, status, ts, version: a row whenever a task's state changes. ``events`` is a stream of task_id, status and ts.

    Events without an id, a status or a time are left out, as are those later than ``late``, which keeps state small.
    """
    spark = events.sparkSession
    spark.conf.set(*STORE)
    clean = events.select(F.col("task_id").cast("string").alias("task_id"), F.col("status").cast("string").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    clean = clean.filter("task_id IS NOT NULL AND status IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return clean.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Lifecycle(keep_days), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )


def replayed(events: DataFrame, out: str, checkpoint: str, late: str = "1 hour", keep_days: int = DEFAULT.keep_days) -> DataFrame:
    """Run the stream over what has arrived, keep each batch's rows in ``out``, and read them.

    A batch that is repeated overwrites its own folder, so a restart after a failure leaves no rows twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = states(events, late, keep_days).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_changes(events.sparkSession, out)


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{OUTPUT}, batch long").parquet(out)


def current(changes: DataFrame) -> DataFrame:
    """task_id, status and ts of each task's last change; expired tasks are gone. Versions grow within a batch; a task that came back can start anew in a later one."""
    last = Window.partitionBy("task_id").orderBy(F.desc("batch"), F.desc("version"))
    return changes.withColumn("__n", F.row_number().over(last)).filter(f"__n = 1 AND status <> '{EXPIRED}'").select("task_id", "status", "ts")

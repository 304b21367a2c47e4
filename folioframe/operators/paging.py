"""Run a kernel on the rows of each page, many pages a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to four tasks a core, or a quarter of the session's shuffle partitions if those are more.

    Spark joins small shuffle partitions by their bytes. Numbers of pages and positions are packed to a few bits a row, so it
    would put millions of rows, and all that is made of them, into a handful of tasks. To be placed before a ``distinct``
    or grouping by the same keys, whose own shuffle Spark would keep instead.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 4 * spark.sparkContext.defaultParallelism), *keys)


def by_page(df: DataFrame, kernel: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` gets the rows of one page (page_id first among the columns) and returns output rows; rows without a page have none.

    Rows are dealt by page and sorted, and batches hold many pages, so small pages cost no call of their own. A page that
    goes on in the next batch is kept back: a worker holds one batch and one page at most.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    page = attrgetter("page_id")

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame.itertuples(index=False), key=page)
        return pd.DataFrame([x for _, g in groupby(rows, page) for x in kernel(list(g))], columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # frames of the page that is still open, put together once
        for frame in frames:
            if frame.empty:
                continue
            open_page = frame.page_id == frame.page_id.iloc[-1]
            if held and not open_page.all():
                yield made(pd.concat([*held, frame[~open_page]]))
                held = []
            elif held and held[-1].page_id.iloc[-1] != frame.page_id.iloc[0]:
                yield made(pd.concat(held))
                held = []
            elif not open_page.all():
                yield made(frame[~open_page])
            held.append(frame[open_page])
        if held:
            yield made(pd.concat(held))

    return dealt(df.filter("page_id IS NOT NULL"), "page_id").sortWithinPartitions("page_id").mapInPandas(run, schema)


def of_pages(df: DataFrame, kernel: Callable[[pa.Table], pa.Table], together: bool = False) -> DataFrame:
    """``kernel`` gets the rows of whole pages, many pages a table, and returns those that stay; rows without a page come as they are.

    Columns stay in Arrow, so rows that a kernel only lets pass cost no Python objects. Rows are dealt by page and sorted unless they
    lie ``together``, as a window over the pages leaves them. A worker holds one batch and one page at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the page that is still open

        def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from kernel(pa.Table.from_batches(parts)).to_batches()

        for batch in batches:
            page = batch.column("page_id")
            if not len(page):
                continue
            if held and held[-1].column("page_id")[-1] != page[0]:
                yield from made(held)
                held = []
            # Rows of one page lie together: the open page's are the last ones.
            start = len(page) - (pc.sum(pc.equal(page, page[-1])).as_py() or 0)
            if start:
                yield from made([*held, batch.slice(0, start)])
                held = []
            if start < len(page):
                held.append(batch.slice(start))
        if held:
            yield from made(held)

    return (df if together else dealt(df, "page_id").sortWithinPartitions("page_id")).mapInArrow(run, df.schema)

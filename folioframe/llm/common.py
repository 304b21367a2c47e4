"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: The white space that separates words everywhere in this subpackage (bytes.split() cuts at the same bytes).
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows handed to a Python worker at once, so that a batch of very long texts stays within a worker's memory.
ARROW_ROWS = 256

_own_folder: str | None = None
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch; a smaller value that the user has set stays. Workers are told where the package is."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew if the scan gives fewer partitions than there are cores (small files of one row group); else leave them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine may name none and gets a temporary one; on a cluster that is an error."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="folioframe-")
    return _own_folder


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete what is made durable inside, but for the result: ``with passing(spark) as last: ... return last(df)``."""
    mark, results = len(_written), []

    def last(df: DataFrame) -> DataFrame:
        out = durable(df)
        results.append(_written[-1])
        return out

    try:
        yield last
    finally:
        made, _written[mark:] = _written[mark:], results
        _delete(spark, [p for p in made if p not in results])


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += path.getFileSystem(conf).delete(path, True)
    return n


def clear(spark: SparkSession) -> int:
    """Delete the tables that durable() has written in this process; call it when the results that read them are stored."""
    paths, _written[:] = list(_written), []
    return _delete(spark, paths)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame has not, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name

"""Staging tables for input that is used more than once, and for what must be settled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("start the session with spark.checkpoint.dir set to a folder that all executors share")
    return folder


def new_folder(spark: SparkSession) -> str:
    """A path for a new folder where staging tables go; `release` deletes it with them."""
    path = f"{_folder(spark).rstrip('/')}/tertulia-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the folder the session names in spark.checkpoint.dir (or else was given by
    setCheckpointDir) and read it back.

    This cuts the lineage, survives the loss of executors, and gives Catalyst the true size of
    the rows, so a small batch is broadcast to a large table and a large one is not. It also
    settles ids that depend on the present state of a table. The folder stays until `release`.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete what this process has staged (from the `since`-th table on). Results that read it must
    have been written or collected by then."""
    configuration = spark._jsc.hadoopConfiguration()
    while len(_staged) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged[-1])
        path.getFileSystem(configuration).delete(path, True)
        _staged.pop()


def settle(df: DataFrame) -> DataFrame:
    """`stage`, and ask for the shuffle files that led to the table to go: Spark deletes them when the
    driver's garbage is collected, which on a driver with little to do may be long after."""
    staged = stage(df)
    staged.sparkSession._jvm.System.gc()
    return staged


def discard(staged: DataFrame) -> None:
    """Delete one table that `stage` returned and nothing reads any more, before `release` would."""
    spark = staged.sparkSession
    configuration = spark._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)


def stage_result(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Stage what `build` returns, and delete what was staged on the way to it."""
    before = len(_staged)
    result = stage(build())
    own = _staged.pop()
    release(spark, before)
    _staged.append(own)
    return result


@contextmanager
def shared(df: DataFrame) -> Iterator[DataFrame]:
    """Keep an input that several reports read, such as the course labels, while they run."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what was staged in it."""
    before = len(_staged)
    try:
        yield
    finally:
        release(spark, before)

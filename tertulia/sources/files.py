"""Small file operations on whatever store a path is in."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    where, store = _at(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; a folder that does not exist holds nothing."""
    where, store = _at(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of that name; False if there is. Stores that create files
    atomically let one of several writers win."""
    where, store = _at(spark, path)
    own = store.getUri().getScheme() == "file"  # Hadoop's local store looks first and creates then, which two writers can do at one time
    if own:
        store.mkdirs(where.getParent())
        if not store.pathToFile(where).createNewFile():
            return False
    try:
        out = store.create(where, own)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass()):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""

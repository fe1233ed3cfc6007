"""Writing results. A path that is being read is never overwritten."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> None:
    """Write a whole table to a new path; fails if the path exists.

    `cluster_by` sorts the files by range, so that a later filter on its first column skips
    row groups. Give enough columns to tell rows apart: a range cannot split one value.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("errorifexists").parquet(path)


def append_rows(
    df: DataFrame, location: str, fmt: str = "parquet", options: Mapping[str, str] | None = None
) -> None:
    """Add rows to a table, leaving the rows already there alone.

    fmt="table"  `location` is the table's name in the catalog; columns go by name
    fmt="jdbc"   `options` has the url and what else the driver needs; `location` is the table
    otherwise    a file format; new files are added to the folder `location`
    """
    options = dict(options or {})
    if fmt == "table":
        given = {c.lower() for c in df.columns}
        columns = [
            (F.col(f.name) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in df.sparkSession.table(location).schema
        ]
        df.select(*columns).write.insertInto(location)
        return
    writer = df.write.format(fmt).mode("append").options(**options)
    writer.option("dbtable", location).save() if fmt == "jdbc" else writer.save(location)


def merge_changed(changed: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Put the rows of `Change.changed` in place of those with the same keys, where the catalog's
    tables can be merged into."""
    named = changed.alias("changed")
    same = reduce(and_, [F.col(f"changed.{k}") == F.col(f"{table}.{k}") for k in keys])
    named.mergeInto(table, same).whenMatched().updateAll().merge()

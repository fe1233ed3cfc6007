"""Layouts of large tables that save shuffles and reading: buckets by key in the catalog, folders by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "mes"


def write_buckets(df: DataFrame, table: str, by: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Write a whole table to the session catalog in buckets by `by`, sorted within them.

    Tables with the same buckets by the same key are joined and counted by it without a shuffle of
    either. Rows are dealt to their buckets first, so a bucket is one file; a key with a large share of the
    rows makes a large bucket, so bucket by what is even, such as the member of a participation.
    """
    dealt = df.repartition(buckets, *by)
    writer = dealt.write.bucketBy(buckets, *by).sortBy(*by).mode("errorifexists").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def month_of(day: str | Column) -> Column:
    """The first day of a day's month; days that are missing have none."""
    return F.trunc(day, "MM").cast("date")


def write_by_month(fact: DataFrame, events: DataFrame, key: str, day: str, path: str) -> None:
    """Write a participation table in folders by the month of the event it refers to, such as a session.

    A filter on the events then prunes the folders, also one that names no date: see
    `reports.period_attendance`. Rows of events without a day, or of none at all, are in the folder of no
    month. Adaptive execution splits large months.
    """
    months = events.groupBy(key).agg(F.min(month_of(day)).alias(MONTH))
    placed = fact.join(months, key, "left").select(*fact.columns, MONTH)
    placed.hint("rebalance", MONTH).write.mode("errorifexists").partitionBy(MONTH).parquet(path)

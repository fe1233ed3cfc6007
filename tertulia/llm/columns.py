"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once however often and deep `use` refers to it.

    A column that is merely selected first may be put back by the optimizer into a lambda that
    refers to it, and be computed for every element there.
    """
    return F.transform(F.array(value), use)[0]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front while `df` has a column of that name."""
    return free_names(df, [name])[0]


def free_names(df: DataFrame, names: Sequence[str]) -> list[str]:
    taken = {c.lower() for c in df.columns}
    mark = ""
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]

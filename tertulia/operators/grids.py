"""Edited grids as change rows: what differs between a table as it was shown and as it came back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edits:
    """What an edit did, by key.

    changed   a row for each key whose row differs: the key, and for each other column the new value where it
              differs, null where it does not; `columnas` names those that do. Updates take such rows as they are,
              for a missing value leaves the old one alone; a cell that was emptied is null, and named
              in `columnas`
    full      the same keys with all values as they came back, for updates that set every value
    added     rows of keys that were not there
    removed   rows of keys that did not come back
    unclear   keys that are missing or stand on several rows on either side, with the rows that changed (`veces`:
              more by so many, or fewer): no one row can be said to have become another
    """

    changed: DataFrame
    full: DataFrame
    added: DataFrame
    removed: DataFrame
    unclear: DataFrame


def grid_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> Edits:
    """Compare two states of a grid, null-safe and with repeated rows, wherever the rows stand.

    One count over both finds the rows that one side has more often; equal rows cancel before anything of
    a key meets, in the map task where they are side by side. Only what is left, about twice the rows that
    were edited, is grouped by key. Columns that `after` lacks were not shown, and count as unchanged.
    """
    columns = [c for c in before.columns if c in after.columns]
    values = [c for c in columns if c not in keys]
    old = before.select(*columns, F.lit(-1).cast("long").alias("_n"))
    new = after.select(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in columns], F.lit(1).cast("long").alias("_n"))
    left = old.unionByName(new).groupBy(*columns).agg(F.sum("_n").alias("veces")).where("veces <> 0")

    def row(side: str):
        return F.struct(*[F.col(c) for c in values]), F.expr(side)

    def of(side: str, name: str):
        struct, holds = row(side)
        return F.max(F.when(holds, struct)).alias(name)

    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    per_key = left.groupBy(*keys).agg(
        of("veces < 0", "_before"),
        of("veces > 0", "_after"),
        F.sum(F.when(F.col("veces") < 0, -F.col("veces")).otherwise(0)).alias("_gone"),
        F.sum(F.when(F.col("veces") > 0, F.col("veces")).otherwise(0)).alias("_come"),
    )
    plain = per_key.where(f"_gone <= 1 AND _come <= 1 AND {known}")
    both = plain.where("_gone = 1 AND _come = 1")
    differs = {c: ~F.col(f"_before.{c}").eqNullSafe(F.col(f"_after.{c}")) for c in values}
    named = F.filter(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]), lambda x: x.isNotNull())
    kind = {c: before.schema[c].dataType for c in values}
    return Edits(
        changed=both.select(*keys, *[F.when(d, F.col(f"_after.{c}")).cast(kind[c]).alias(c) for c, d in differs.items()], named.alias("columnas")),
        full=both.select(*keys, "_after.*"),
        added=plain.where("_gone = 0").select(*keys, "_after.*").select(*columns),
        removed=plain.where("_come = 0").select(*keys, "_before.*").select(*columns),
        unclear=left.join(per_key.where(f"_gone > 1 OR _come > 1 OR NOT ({known})").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), _same(keys), "left_semi"),
    )


def _same(keys: Sequence[str]):
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return condition

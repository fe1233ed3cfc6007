"""Joins and counts that hold up when one key has a large share of the rows.

Joins of a raw table with a raw table are left to adaptive execution, which splits the skewed
partitions of either side. It cannot do so where one side is an aggregate; the helpers below count
instead of joining there, or stage the aggregate. No helper hints a broadcast: Catalyst takes one
where the size it knows allows it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.plans.staging import stage

COPIES_PER_ARRAY = 100_000


def without_match(rows: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct `keys` of `rows` that `present` lacks, with the number of copies in `copias`.

    An anti join of two large tables, done as one count over both: copies collapse before the
    only shuffle, and neither side is sorted.
    """
    wanted = rows.select(*keys, F.lit(1).alias("_rows"), F.lit(0).alias("_present"))
    held = present.dropna(subset=list(keys)).select(*keys, F.lit(0).alias("_rows"), F.lit(1).alias("_present"))
    counted = wanted.unionByName(held).groupBy(*keys).agg(
        F.sum("_rows").alias("copias"), F.max("_present").alias("_present")
    )
    return counted.where("_present = 0").drop("_present")


def repeat_rows(df: DataFrame, count_col: str = "copias", index_col: str = "_copy") -> DataFrame:
    """Give back the copies that were counted, numbered from zero in `index_col`.

    Numbers are made in blocks, so that no array grows with the number of copies, and the blocks of a
    row with more than one of them are dealt to different tasks.
    """
    keep = [c for c in df.columns if c != count_col]
    zero, block = F.lit(0).cast("long"), F.col("_block") * COPIES_PER_ARRAY
    last_block = F.expr(f"({count_col} - 1) div {COPIES_PER_ARRAY}L")
    last = F.least(F.col(count_col), block + COPIES_PER_ARRAY) - 1
    few = df.where(F.col(count_col) <= COPIES_PER_ARRAY).withColumn("_block", zero)
    many = df.where(F.col(count_col) > COPIES_PER_ARRAY).select(
        "*", F.explode(F.sequence(zero, last_block)).alias("_block")
    )
    blocks = few.unionByName(many.repartition(*keep, "_block"))
    return blocks.select(*keep, F.explode(F.sequence(block, last)).alias(index_col))


def drop_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose `keys` are not in `gone`.

    The keys to drop are staged: few are broadcast, and with many of them a key that covers a
    third of `rows` is split, as both sides of the join come straight from a shuffle.
    """
    return rows.join(stage(gone.select(*keys).distinct()), list(keys), "left_anti")


def count_links(entities: DataFrame, sources: Mapping[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """For each key of `entities`, its rows in each of several tables.

    The entities are counted along with the tables, so one shuffle of partial counts does the
    work of a join per table.
    """
    tables = {"_entity": (entities, key), **sources}
    tagged = [
        df.select(F.col(col).alias(key), F.lit(i).alias("_source"))
        for i, (df, col) in enumerate(tables.values())
    ]
    counts = [F.count(F.when(F.col("_source") == i, 1)).alias(name) for i, name in enumerate(tables)]
    counted = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*counts)
    return counted.where("_entity > 0").drop("_entity")


def linked_keys(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys that occur in any of several tables."""
    return reduce(DataFrame.unionByName, [df.select(key) for df in sources]).distinct()


def new_pairs(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Those of the distinct `pairs` that `existing` lacks.

    `existing` is cut down to the pairs at hand first. When these are few, Catalyst moves that
    semi join below the DISTINCT and the large table is scanned, not shuffled; when they are
    many, copies in the large table collapse before its one shuffle.
    """
    held = existing.select(*pairs.columns).distinct().join(pairs, pairs.columns, "left_semi")
    return pairs.join(held, pairs.columns, "left_anti")


def split_known(rows: DataFrame, entity: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """`rows` whose `key` names a row of `entity`, and the others; those without a key are among the others.

    A small entity is broadcast to the rows, which then stay where they are; with a large one, both
    sides come straight from their tables, so a key that most rows name can be split.
    """
    return tuple(rows.join(entity.select(key), key, how).select(*rows.columns) for how in ("left_semi", "left_anti"))


def one_per_key(changes: DataFrame, keys: Sequence[str], order_col: str | None) -> DataFrame:
    """One change row per key: the last by `order_col`, else an error when a key occurs twice."""
    rest = [c for c in changes.columns if c not in keys and c != order_col]
    if order_col:
        row = F.struct(*rest)
        last = changes.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(order_col), row)).alias("_row"))
        return last.select(*keys, "_row.*")
    grouped = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest]
    )
    twice = F.raise_error(F.lit(f"two changes for one {', '.join(keys)}; name an order column"))
    return grouped.select(*keys, *[F.when(F.col("_n") > 1, twice).otherwise(F.col(c)).alias(c) for c in rest])


def settled(
    changes: DataFrame, keys: Sequence[str], order_col: str | None, go_on: bool
) -> tuple[DataFrame, DataFrame | None]:
    """One change row per key, and with `go_on` the rows that were left out because their key has several.

    Rows that say the same are one change. Without `go_on` several changes of a key are an error, unless an order column
    tells which is the last (`one_per_key`).
    """
    if order_col or not go_on:
        return one_per_key(changes, keys, order_col), None
    rest = [c for c in changes.columns if c not in keys]
    # Equal rows collapse first, so a key that is repeated many times is one row per different change.
    different = changes.groupBy(*changes.columns).agg(F.count(F.lit(1)).alias("copias"))
    counted = different.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    twice = stage(counted.where("_n > 1").select(*keys))
    return counted.where("_n = 1").select(*changes.columns), changes.join(twice, list(keys), "left_semi").select(*changes.columns)


def zero_if_null(*cols: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in cols]

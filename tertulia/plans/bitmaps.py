"""Exact distinct counts by bitmaps.

To count once, ids are cut into buckets of 32,768; of each bucket a group holds one bit per id. Rows are dealt by group and
bucket first and sorted there as they are, so each bitmap is filled, counted and dropped before the next one begins.
A bitmap has 4 KB however few bits are set: none is shuffled, sorted or kept, else tables with few ids per
bucket would take many times their size in memory.

To store and merge, bitmaps are words of 64 ids, of which only those with a bit set are there: never more of them than
pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


WORD_BITS = 6


def bitmaps(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """For each group by `keys` and bucket of ids: `_bucket` and `_bits`, to be counted where they are made. A group that
    has no id has one row, of an empty bitmap."""
    placed = rows.select(*keys, F.bitmap_bucket_number(id_col).alias("_bucket"), F.bitmap_bit_position(id_col).alias("_place"))
    dealt = placed.repartition(*keys, "_bucket")
    return dealt.groupBy(*keys, "_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))


def words(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Bitmaps to store: for each group by `keys` and 64 ids of which it has any, `_bucket` and the bits `_bits`, a
    number. A group that has no id has one row, of no bits. Bits are set before the shuffle."""
    placed = rows.select(
        *keys,
        F.shiftright(id_col, WORD_BITS).alias("_bucket"),
        F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(F.expr(f"shiftleft(1L, cast(`{id_col}` & 63 as int))")).alias("_bits"),
    )
    return placed.groupBy(*keys, "_bucket").agg(F.bit_or("_bits").alias("_bits"))


def _in_words(maps: DataFrame) -> bool:
    return maps.schema["_bits"].dataType == LongType()


def merge(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups from those of finer ones."""
    either = F.bit_or if _in_words(maps) else F.bitmap_or_agg
    return maps.groupBy(*keys, "_bucket").agg(either("_bits").alias("_bits"))


def count_ids(maps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many different ids each group has."""
    counted = F.bit_count("_bits").cast("long") if _in_words(maps) else F.bitmap_count("_bits")
    return maps.groupBy(*keys).agg(F.sum(counted).alias(name))

"""Handing out surrogate ids in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tertulia.plans.joins import repeat_rows

HEX_DIGITS = 3  # 16**3 = 4096 buckets: the bound of every per-bucket table below


def with_new_ids(rows: DataFrame, id_col: str, current: DataFrame) -> DataFrame:
    """Number `rows` from one above the highest `id_col` of `current`, without gaps.

    Ids follow the order of an MD5 of the row. Its leading digits cut that order into even
    buckets whose bounds need no sampling, so a task that runs again gives the same ids, and
    only the count of each bucket meets in one place. Equal rows are counted once per bucket
    and spread out again afterwards, each with its own id.
    """
    cols = rows.columns
    content = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    unique = (
        rows.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_md5", F.md5(content))
        .withColumn("_bucket", F.substring("_md5", 1, HEX_DIGITS))
    )
    # At most 4096 rows from here to the broadcast.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = unique.groupBy("_bucket").agg(F.sum("_n").alias("_size")).select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    within = (
        Window.partitionBy("_bucket").orderBy("_md5", *cols).rowsBetween(Window.unboundedPreceding, -1)
    )
    highest = F.coalesce(current.agg(F.max(id_col)).scalar(), F.lit(0).cast("long"))
    first = highest + 1 + F.col("_start") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    numbered = unique.join(F.broadcast(starts), "_bucket").withColumn("_first", first)
    copies = repeat_rows(numbered.select(*cols, "_first", "_n"), "_n", "_copy")
    return copies.select((F.col("_first") + F.col("_copy")).cast("long").alias(id_col), *cols)

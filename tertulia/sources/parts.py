"""Tables kept in parts by a hash of their key: a change rewrites the parts it touches, and no other file.

Parquet has no UPDATE, DELETE or MERGE. A table in parts is a folder partitioned by `parte`, the hash of the key
modulo a fixed number; dynamic partition overwrite puts the parts that hold changed rows in place of the
old ones. Keys and number of parts lie beside the data, in a folder that readers skip.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.plans.staging import stage
from tertulia.sources.files import delete_folder
from tertulia.sources.tables import Change

PART = "parte"
LAYOUT = "_layout"


@dataclass(frozen=True)
class Layout:
    """What rows are told apart by, and into how many parts they go."""

    keys: tuple[str, ...]
    parts: int

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int").alias(PART)


def write_parts(df: DataFrame, path: str, keys: Sequence[str], parts: int = 256) -> None:
    """Write a whole table in parts by a hash of `keys` to a new path.

    Rows of one key share a part, so `keys` should tell most rows apart; a change must name all rows of a
    key it touches. With `parts` about the size of the table over 256 MB, a part is a file or two. Adaptive
    execution deals the parts to tasks and splits a large one.
    """
    layout = Layout(tuple(keys), parts)
    placed = df.select("*", layout.part()).hint("rebalance", PART)
    placed.write.mode("errorifexists").partitionBy(PART).parquet(path)
    described = df.sparkSession.createDataFrame([(list(keys), parts)], "keys array<string>, parts int")
    described.coalesce(1).write.json(f"{path}/{LAYOUT}")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def layout_of(spark: SparkSession, path: str) -> Layout:
    found = spark.read.schema("keys array<string>, parts int").json(f"{path}/{LAYOUT}").first()
    return Layout(tuple(found["keys"]), found["parts"])


def rewrite_parts(spark: SparkSession, path: str, change: Change, table: str) -> list[int]:
    """Apply what `change` does to `table`, stored at `path`, and return the parts that were rewritten.

    The rows of every key in `changed` or `removed` go; those of `changed` and `added` come. Only parts of these
    keys are read and replaced. What they will hold is staged first, so the change may have been made from this very
    path, and nothing is replaced before all of it is known. A driver that is lost while parts are
    replaced leaves old and new ones; making and writing the change again completes it.
    """
    layout = layout_of(spark, path)
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != PART]
    found = lambda kind: [kind[table].select(*columns)] if table in kind else []
    changed = [stage(df) for df in found(change.changed)]  # what an update makes of the table is made once
    gone, come = changed + found(change.removed), changed + found(change.added)
    nothing = stored.select(*columns).limit(0)
    keys = stage(reduce(DataFrame.unionByName, gone, nothing).select(*layout.keys).distinct().select("*", layout.part()))
    rows = stage(reduce(DataFrame.unionByName, come, nothing).select("*", layout.part()))
    # At most as many numbers as there are parts.
    touched = sorted(r[0] for r in keys.select(PART).union(rows.select(PART)).distinct().collect())
    if not touched:
        return []
    kept = stored.where(F.col(PART).isin(touched)).join(keys.drop(PART), list(layout.keys), "left_anti")
    new = stage(kept.select(*columns, PART).unionByName(rows))
    filled = {r[0] for r in new.select(PART).distinct().collect()}
    new.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for part in set(touched) - filled:  # dynamic overwrite leaves alone what no row goes to
        delete_folder(spark, f"{path}/{PART}={part}")
    spark.catalog.refreshByPath(path)
    return touched

"""Appending the rows of a change so that a lost driver may write it again, and two writers share no id.

A table that takes batches is a folder partitioned by `lote`, the key of the batch a row came with. A batch becomes
visible by one rename of its partition, and a batch that is there is not written again.

New ids are handed out when a change is made, from the highest id there is then. Two changes made from one
state have the same ids; so before its first row is written, a batch claims its range of ids, and where
another batch has claimed them it moves to the next free ones, along with the links that name them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.schemas import SCHEMAS
from tertulia.sources.files import create_new, exists, names_in, read_small
from tertulia.sources.tables import Change

BATCH = "lote"
FIRST_BATCH = "inicial"
LOG, CLAIMS = "_lotes", "_ids"  # readers of tables skip both
#: The tables whose ids are handed out, in the order in which they may be written.
IDS = {
    "comunidad": "id_usuario",
    "instructor": "id_instructor",
    "catalogo_cursos": "id_catalogo",
    "sesion": "id_sesion",
    "curso": "id_curso",
    "clase": "id_clase",
}


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add rows to the folder of a table under the key `batch`; False, and nothing is written, if that batch is there."""
    spark = df.sparkSession
    if exists(spark, f"{path}/{BATCH}={_escaped(spark, batch)}"):
        return False
    rows = df.withColumn(BATCH, F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)
    return True


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def store_batches(tables: Mapping[str, DataFrame], location: str) -> None:
    """Write whole tables as the first batch of folders that take batches."""
    for name, df in tables.items():
        append_batch(df, f"{location}/{name}", FIRST_BATCH)


def write_change(spark: SparkSession, change: Change, location: str, batch: str) -> list[str]:
    """Append all that `change` adds to the tables below `location`; the tables written by this call.

    `batch` names the change, as a submission's number does. The rows are settled in a log first, with their final ids.
    Written again under the same name, by a driver that does not know how far the last one came, the
    logged rows count and not those of the new `change`; tables that have the batch are left out.
    Links are written before the rows they belong to, so no run is ever there without its links.

    Of two drivers that write one batch at a time, either may win a table; both write the same logged rows.
    """
    log = f"{location}/{LOG}/{quote(batch, safe='')}"
    if not exists(spark, f"{log}/_complete"):
        added = with_free_ids(spark, change, location)
        for name, df in added.items():
            df.write.mode("overwrite").parquet(f"{log}/{name}")
        create_new(spark, f"{log}/_complete", json.dumps(sorted(added)))
    names = [n for n in names_in(spark, log) if n in SCHEMAS]
    written = []
    for name in sorted(names, key=lambda n: (n in IDS, n)):
        logged = spark.read.schema(SCHEMAS[name]).parquet(f"{log}/{name}")
        if append_batch(logged, f"{location}/{name}", batch):
            written.append(name)
    return written


def with_free_ids(spark: SparkSession, change: Change, location: str) -> Mapping[str, DataFrame]:
    """What `change` adds, with ids that no other batch has claimed."""
    added = dict(change.added)
    for table, id_col in IDS.items():
        if table not in added:
            continue
        low, high = added[table].agg(F.min(id_col), F.max(id_col)).first()
        if low is None:
            continue
        moved = claim_ids(spark, location, table, low, high - low + 1) - low
        if moved:
            for name, df in added.items():
                if id_col in df.columns and (name == table or name not in IDS):
                    added[name] = df.withColumn(id_col, F.col(id_col) + moved)
    return added


def claim_ids(spark: SparkSession, location: str, table: str, wanted: int, n: int, patience: float = 60.0) -> int:
    """Claim `n` ids in a row and return the first: `wanted` if that is free, else the next that is.

    Claims are numbered files; each holds the last id it covers, and a number can be taken once. A claim
    begins above the highest id of the table and above all claims before it.
    """
    folder, id_col = f"{location}/{CLAIMS}/{table}", IDS[table]
    deadline = time.monotonic() + patience
    while True:
        numbers = sorted(int(x) for x in names_in(spark, folder) if x.isdigit())
        last = read_small(spark, f"{folder}/{numbers[-1]}") if numbers else "0"
        if not last:  # taken, but its writer has not said yet up to where
            if time.monotonic() > deadline:
                raise RuntimeError(f"the claim {folder}/{numbers[-1]} was never finished; delete it")
            time.sleep(0.2)
            continue
        highest = spark.read.schema(SCHEMAS[table]).parquet(f"{location}/{table}").agg(F.max(id_col)).first()[0] or 0
        first = max(wanted, highest + 1, int(last) + 1)
        if create_new(spark, f"{folder}/{numbers[-1] + 1 if numbers else 1}", str(first + n - 1)):
            return first

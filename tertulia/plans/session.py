"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key also where the joined rows are counted by that key, at the price of a shuffle then.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
LOCAL = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def cluster_settings(input_gb: float, checkpoint_dir: str, partition_mb: int = 256) -> Mapping[str, str]:
    """What to launch a session on a cluster with, for the largest table it shuffles.

    Adaptive execution joins small partitions but starts from the number it is given, so there must
    be enough of them: one for every `partition_mb` of input. Partitions of four times that are split.
    """
    partitions = max(200, round(input_gb * 1024 / partition_mb))
    return {
        **SETTINGS,
        "spark.checkpoint.dir": checkpoint_dir,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{partition_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * partition_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def local_session(cpus: str | int = 8, **more: str) -> SparkSession:
    """A session on this machine, for tests and benches.

    Where the machine's defaults name no spark.checkpoint.dir, it gets a temporary folder.
    """
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tertulia")
    settings = {**SETTINGS, **LOCAL, "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g", **more}
    spark = builder.config(map=settings).getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.stop()
        folder = tempfile.mkdtemp(prefix="tertulia-")
        spark = builder.config(map={**settings, "spark.checkpoint.dir": folder}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

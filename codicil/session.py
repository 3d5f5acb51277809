"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Behaviour (not sizing) settings: every job in this package assumes them.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole texts: a batch is bounded by its bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Parquet stamps without a zone are UTC instants.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session the caller owns."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "codicil", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # One machine and small tables: keep every core busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    return configure(builder.getOrCreate())


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    session, where driver and executors share one disk, may fall back to a
    temporary folder; a cluster without the setting is an error, because its
    executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several branches: the written table survives
    the loss of executors, which cached blocks do not.
    """
    spark = df.sparkSession
    folder = work_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)

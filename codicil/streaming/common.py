"""Plumbing shared by the streaming jobs: sources, sinks, result folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codicil.session import work_folder


def file_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream; ``glob`` picks files or folders of files within it."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A table may be one file or a folder of parts; a filter on file names would skip every part.
    # Braces make the path a pattern: Spark takes a plain path for a folder.
    return reader.load(f"{path.rstrip('/')}/{{{glob}}}" if glob else path)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> str:
    """Run a stream over everything available into a Parquet folder and return it."""
    target = folder or work_folder(stream.sparkSession, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{target}-checkpoint").option("path", target)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return target


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append",
                  checkpoint: str | None = None) -> None:
    """Run a stream over everything available through ``foreachBatch``."""
    location = checkpoint or work_folder(stream.sparkSession, "batches")
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", location)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_updates(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run an update-mode stream and return the newest row of each key.

    Every micro-batch overwrites its own folder, so a batch that is retried
    after a failure leaves the same rows.
    """
    spark = stream.sparkSession
    target = folder or work_folder(spark, "updates")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    drain_batches(stream, write, "update", f"{target}-checkpoint")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(target)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])

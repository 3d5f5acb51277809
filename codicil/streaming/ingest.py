"""Discovery of files and grouped micro-batch ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators.chunks import chunk_documents
from codicil.scale import winners
from codicil.sources.sinks import prepare_documents
from codicil.streaming.common import drain_batches

BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def discover(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """path, size, mtime, content of files as they appear."""
    raw = (
        spark.readStream.format("binaryFile").schema(BINARY)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    )
    return raw.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("content").cast("string").alias("content"),
    )


def ingest(stream: DataFrame, folder: str, chunk_columns: tuple[str, ...] = ()) -> None:
    """One document write and one chunk write per micro-batch.

    ``stream`` holds doc_id, content and version.  Of several rows of a document the
    highest version counts, of equal versions one by a hash of the row.  Each
    micro-batch writes its own epoch folder under chunks/ and then documents/, so
    repeating a batch is harmless and a document shows only with its chunks;
    ``documents`` and ``chunks`` below show the newest state.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        ready = prepare_documents(winners(batch, ["doc_id"], [F.col("version")])).persist()
        chunk_documents(ready, keep=chunk_columns).write.mode("overwrite").parquet(f"{folder}/chunks/epoch={epoch}")
        ready.write.mode("overwrite").parquet(f"{folder}/documents/epoch={epoch}")
        ready.unpersist()

    drain_batches(stream, write, checkpoint=f"{folder}/checkpoint")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Stored documents, newest epoch of each."""
    rows = spark.read.parquet(f"{folder}/documents")
    newest = rows.groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["doc_id", "epoch"], "left_semi")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the newest epoch of each document: one file, one state."""
    rows = spark.read.parquet(f"{folder}/chunks")
    newest = spark.read.parquet(f"{folder}/documents").groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["doc_id", "epoch"], "left_semi")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Per-document outcome: chunk count and whether there was any content."""
    counts = chunks(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return documents(spark, folder).join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("has_content").alias("success")
    )

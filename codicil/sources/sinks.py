"""Writers: upserts, chunk replacement, cascaded deletes, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.text import is_blank
from codicil.scale import keep_first, winners


def prepare_documents(batch: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds ``has_content`` and, if asked, the stored-content limit of 100 000 characters."""
    content = F.coalesce(F.col("content"), F.lit(""))
    if max_chars is not None:
        content = F.substring(content, 1, max_chars)
    return batch.withColumn("has_content", ~is_blank(F.col("content"))).withColumn("content", content)


def latest_per_key(df: DataFrame, key: str, version: str, row_id: str) -> DataFrame:
    """Last write of each key; ``row_id`` is unique and breaks equal versions."""
    return keep_first(
        df.withColumn("_neg", -F.unix_micros(version)), [key], [F.col("_neg"), -F.col(row_id)], [row_id]
    ).drop("_neg")


def upsert_documents(target: DataFrame, batch: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Target after the batch: rows of a written key are replaced, others kept.

    The batch holds one row per key, or ``version`` names the column whose highest
    value wins (ties by a hash of the row).
    """
    kept = target.join(batch.select(key), key, "left_anti")
    written = winners(batch, [key], [F.col(version)]) if version else batch
    return kept.unionByName(written, allowMissingColumns=True)


def replace_chunks(target: DataFrame, doc_ids: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the named documents are dropped, then the new ones added.

    The result is one DataFrame, so a failed run leaves the old table whole.
    """
    return target.join(doc_ids, "doc_id", "left_anti").unionByName(new)


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the deleted documents: no chunk is orphaned."""
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def with_positions(results: DataFrame, position: str = "pos") -> DataFrame:
    """Per-item outcomes in request order."""
    return results.orderBy(position)


class Publication:
    """Versioned folders of one table behind a view.

    ``build`` writes the next version beside the live one; ``swap`` moves the
    view; swapping again rolls back.  The state is two small pointer files in
    the table's folder, so any driver can pick it up.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, which: str) -> str | None:
        path = self._fs_path(f"{self.folder}/{which}")
        if not self._fs.exists(path):
            return None
        return self.spark.read.text(str(path.toString())).first()[0]

    def _point(self, which: str, version: str) -> None:
        path = self._fs_path(f"{self.folder}/{which}")
        out = self._fs.create(path, True)
        out.write(bytearray(version.encode()))
        out.close()

    @property
    def live(self) -> str | None:
        return self._pointer("LIVE")

    @property
    def previous(self) -> str | None:
        return self._pointer("PREVIOUS")

    def build(self, df: DataFrame, version: str, check=None) -> None:
        """Write and validate a version; the live one is untouched on any failure."""
        target = f"{self.folder}/{version}"
        df.write.mode("errorifexists").parquet(target)
        written = self.spark.read.schema(df.schema).parquet(target)
        if check is not None and not check(written):
            raise ValueError(f"version {version} of {self.name} failed its check")
        self._point("NEXT", version)

    def swap(self) -> None:
        target = self._pointer("NEXT")
        if target is None:
            raise ValueError(f"nothing built for {self.name}")
        self._activate(target)

    def rollback(self) -> None:
        if self.previous is None:
            raise ValueError(f"{self.name} has no previous version")
        self._activate(self.previous)

    def _activate(self, version: str) -> None:
        was = self.live
        self._point("LIVE", version)
        if was is not None:
            self._point("PREVIOUS", was)
        self.read().createOrReplaceTempView(self.name)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.live}")


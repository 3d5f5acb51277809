"""Change detection, scope rules and set logic over file and index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import paths
from codicil.functions.text import glue_cjk, is_blank
from codicil.scale import small_or_shuffled


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, change_type (new, modified, deleted, unchanged) of two snapshots."""
    joined = previous.select("path", F.col("mtime").alias("_was"), F.lit(True).alias("_p")).join(
        current.select("path", F.col("mtime").alias("_is"), F.lit(True).alias("_c")), "path", "full_outer"
    )
    kind = (
        F.when(F.col("_p").isNull(), "new")
        .when(F.col("_c").isNull(), "deleted")
        .when(~F.col("_was").eqNullSafe(F.col("_is")), "modified")
        .otherwise("unchanged")
    )
    return joined.select("path", kind.alias("change_type"))


def _outermost(roots: DataFrame) -> DataFrame:
    """Roots not lying under another root, so that a path meets at most one."""
    roots = roots.select(F.regexp_replace("root", "(?<=.)/+$", "").alias("root")).distinct()
    above = roots.select("root", F.explode(paths.ancestors(F.col("root"))).alias("_a")).where("_a <> root")
    inner = above.join(roots.select(F.col("root").alias("_a")), "_a", "left_semi").select("root").distinct()
    return roots.join(inner, "root", "left_anti")


def under_roots(df: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is a root or lies below one.

    Each path is expanded into its own ancestors and met with the roots by
    equality, so the prefix test never compares every path with every root.
    """
    known = small_or_shuffled(_outermost(roots))
    return (
        df.withColumn("root", F.explode(paths.ancestors(F.col(path)))).join(known, "root", "left_semi").drop("root")
    )


def deleted_under_live_roots(diff: DataFrame, live_roots: DataFrame) -> DataFrame:
    """Deletions, only below roots that exist now (an unmounted volume deletes nothing)."""
    return under_roots(diff.where("change_type = 'deleted'"), live_roots)


def _rows(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery: decided when the query runs, not while it is built."""
    return df.agg(F.count("*")).scalar()


def out_of_scope(df: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Paths under no configured root; without roots nothing is out of scope."""
    outside = df.join(under_roots(df.select(path), roots, path), path, "left_anti")
    return outside.where(_rows(roots) > 0)


def within_roots(df: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Allow-list at ingest; without roots everything is allowed."""
    return df.where(_rows(roots) == 0).unionByName(under_roots(df, roots, path))


def reconcile_orphans(seen: DataFrame, indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Unchanged files missing from the index; an empty inventory disables it."""
    return seen.join(indexed.select(key), key, "left_anti").where(_rows(indexed) > 0)


def drop_exhausted(files: DataFrame, failures: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    return files.join(failures.where(F.col("retry_count") >= max_retries).select("path"), "path", "left_anti")


def flag_deleted(results: DataFrame, trash: DataFrame) -> DataFrame:
    marks = trash.select("path", F.lit(True).alias("deleted"))
    return results.join(marks, "path", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def skip_up_to_date(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files still to index: not stored, stored with another mtime, or forced.

    A stored document without an mtime counts as up to date.
    """
    stored = index.select("path", F.col("mtime").alias("_stored"), F.lit(True).alias("_known"))
    fresh = F.col("_known").isNotNull() & (
        F.col("_stored").isNull() | (F.abs(F.col("mtime") - F.col("_stored")) < fv.MTIME_TOLERANCE)
    )
    return files.join(stored, "path", "left").where(F.col("force") | ~fresh).select(*files.columns)


def chunks_of(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return chunks.join(small_or_shuffled(doc_ids.select("doc_id").distinct()), "doc_id", "left_semi")


def classify_for_copy(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows for the next index: copied as is, or to reindex because gluing changes the text."""
    glued = docs.withColumn("_glued", glue_cjk(F.coalesce("content", F.lit(""))))
    same = F.col("_glued") == F.coalesce("content", F.lit(""))
    return (
        glued.join(vectors.select("doc_id", "vector"), "doc_id", "left")
        .withColumn("population", F.when(same, "copy").otherwise("reindex"))
        .withColumn("vector", F.when(same, F.col("vector")))
        .withColumn("has_vector", F.col("vector").isNotNull())
        .withColumn("has_content", ~is_blank(F.col("_glued")))
        .withColumn("content", F.col("_glued"))
        .drop("_glued")
    )


def copy_report(classified: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of copy totals."""
    copied = F.col("population") == "copy"
    docs = classified.agg(
        F.count("*").alias("docs_total"),
        F.count_if(copied).alias("docs_copied"),
        F.count_if(copied & ~F.col("has_vector")).alias("docs_without_vector"),
        F.count_if(~copied).alias("docs_needing_reindex"),
        F.count_if(~copied & ~F.col("source_exists")).alias("docs_source_missing"),
    )
    kept = chunks.join(classified.where(copied).select("doc_id"), "doc_id", "left_semi")
    total, n_kept = chunks.agg(F.count("*")).scalar(), kept.agg(F.count("*")).scalar()
    return docs.withColumns({"chunks_total": total, "chunks_copied": n_kept}).withColumn(
        "chunks_excluded", F.col("chunks_total") - F.col("chunks_copied")
    )


def path_coverage(eligible: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per extension: eligible, indexed and remaining files."""
    marks = indexed.select("path", F.lit(True).alias("_in")).distinct()
    ext = F.when(paths.extension(F.col("path")) == "", "(noext)").otherwise(paths.extension(F.col("path")))
    return (
        eligible.select("path").distinct().join(marks, "path", "left")
        .groupBy(ext.alias("extension"))
        .agg(
            F.count("*").alias("eligible"),
            F.count_if(F.col("_in").isNotNull()).alias("indexed"),
            F.count_if(F.col("_in").isNull()).alias("remaining"),
        )
    )


def inflight_dedupe(new: DataFrame, tasks: DataFrame) -> DataFrame:
    """New work without what is already pending for the same path and type."""
    pending = tasks.where("status = 'pending'").select("file_path", "task_type").distinct()
    return new.join(pending, ["file_path", "task_type"], "left_anti")


def to_enqueue(diff: DataFrame, reconciled: DataFrame) -> DataFrame:
    """New, modified and kept reconciled files as one work list."""
    changed = diff.where(F.col("change_type").isin("new", "modified"))
    return changed.unionByName(reconciled.select("path", F.lit("reconciled").alias("change_type")))


def exclude_prefix(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Rows outside a quarantined folder."""
    folder = prefix.rstrip("/")
    return df.where((F.col(path) != folder) & ~F.startswith(F.col(path), F.lit(folder + "/")))


def group_by_parent(df: DataFrame, path: str = "path") -> DataFrame:
    """parent, n_paths, path: one row per path, ready to be written by parent.

    The paths of a folder stay rows rather than one list, because a folder may
    hold any share of the corpus; its count is aggregated partially first.
    """
    rows = df.select(paths.parent(F.col(path)).alias("parent"), F.col(path).alias("path"))
    counts = rows.groupBy("parent").agg(F.count("*").alias("n_paths"))
    return rows.join(counts, "parent")


def scan_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def empty_documents(docs: DataFrame) -> DataFrame:
    return docs.where(is_blank(F.col("content")) | ~F.coalesce("has_content", F.lit(False)))


def healthy_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(F.col("has_content")).select(key)


def get_document(docs: DataFrame, value, key: str = "doc_id") -> DataFrame:
    return docs.where(F.col(key) == value)


def sample_checks(asks: DataFrame, stored: DataFrame, vectors: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, present, has_vector, search_found`` of expected documents (``asks``: query_id is the key).

    ``found`` holds the hits (query_id, ``<key>``) of a search for each document's title.
    """
    expected = asks.select(F.col("query_id").alias(key)).distinct()
    marks = [
        (stored.select(key), "present"), (vectors.select(key), "has_vector"), (found.where(F.col("query_id") == F.col(key)).select(key), "search_found"),
    ]
    for rows, name in marks:
        expected = expected.join(rows.distinct().withColumn(name, F.lit(True)), key, "left")
    return expected.select(key, *[F.coalesce(name, F.lit(False)).alias(name) for _, name in marks])

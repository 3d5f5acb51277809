"""Statistics over tasks, failures, events, files and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import paths
from codicil.functions.text import expected_scripts, is_garbled, missing_script, word_count


def extension_bucket(path: Column) -> Column:
    ext = paths.extension(path)
    return F.when(ext == "", "(noext)").otherwise(ext)


# --- tasks ---------------------------------------------------------------------------


def task_stats(tasks: DataFrame) -> DataFrame:
    """One row: total and a count per status (other statuses only in the total)."""
    return tasks.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in fv.TASK_STATUSES]
    )


def tasks_by_type(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_type").agg(F.count("*").alias("n"))


def pending_by_priority(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending'").groupBy("priority").agg(F.count("*").alias("n"))


def priority_rank(priority: Column) -> Column:
    return F.create_map(*[x for i, p in enumerate(fv.TASK_PRIORITIES) for x in (F.lit(p), F.lit(i))])[priority]


def rank_pending(tasks: DataFrame, n: int) -> DataFrame:
    """The next ``n`` pending tasks: priority first, then age."""
    pending = tasks.where("status = 'pending'").withColumn("priority_rank", priority_rank(F.col("priority")))
    return pending.orderBy("priority_rank", "added_at", "id").limit(n)


def list_tasks(tasks: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    chosen = tasks.where(F.col("status") == status) if status else tasks
    return chosen.orderBy(F.desc("added_at"), F.desc("id")).limit(limit)


def find_tasks(tasks: DataFrame, needle: str) -> DataFrame:
    return tasks.where(F.contains("file_path", F.lit(needle)))


def retry_failed(tasks: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """Failed tasks below the retry ceiling become pending again."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < max_retries)
    return tasks.withColumns(
        {
            "status": F.when(again, "pending").otherwise(F.col("status")),
            "error_message": F.when(again, F.lit(None)).otherwise(F.col("error_message")),
        }
    )


def reset_stuck(tasks: DataFrame, now: Column, timeout_seconds: int = fv.STUCK_SECONDS) -> DataFrame:
    """Tasks processing for longer than the timeout (or with no start) become pending."""
    age = F.timestamp_diff("SECOND", F.col("started_at"), now)
    stuck = (F.col("status") == "processing") & (F.col("started_at").isNull() | (age > timeout_seconds))
    return tasks.withColumns(
        {
            "status": F.when(stuck, "pending").otherwise(F.col("status")),
            "started_at": F.when(stuck, F.lit(None)).otherwise(F.col("started_at")),
        }
    )


def duration_seconds() -> Column:
    return (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6


def duration_stats(tasks: DataFrame) -> DataFrame:
    """n, mean, min and max of positive task durations per extension."""
    timed = tasks.where("status = 'completed'").withColumn("_d", duration_seconds()).where("_d > 0")
    return timed.groupBy(extension_bucket(F.col("file_path")).alias("extension")).agg(
        F.count("*").alias("n"), F.avg("_d").alias("mean_s"), F.min("_d").alias("min_s"), F.max("_d").alias("max_s"),
    )


def throughput_eta(
    tasks: DataFrame, remaining: DataFrame, now: Column, window_minutes: int = fv.ETA_WINDOW_MINUTES
) -> DataFrame:
    """One row: recent rate, expected seconds for (extension, n) remaining files, confidence.

    An extension with three samples or more uses its own mean duration, else
    the global mean; with no durations the rate decides; else nothing is known.
    """
    cutoff = now - F.expr(f"INTERVAL {window_minutes} MINUTES")
    recent = tasks.where((F.col("status") == "completed") & (F.col("completed_at") >= cutoff)).withColumn("_d", duration_seconds())
    timed = F.col("_d") > 0
    per_ext = recent.groupBy(extension_bucket(F.col("file_path")).alias("extension")).agg(
        F.count("*").alias("_all"), F.count_if(timed).alias("_n"), F.sum(F.when(timed, F.col("_d"))).alias("_sum")
    )
    totals = per_ext.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("recent_completed"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("sample_size"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"),
    )
    own = F.when(F.col("_n") >= fv.ETA_MIN_SAMPLES, F.col("_sum") / F.col("_n"))
    work = (
        remaining.where("n > 0").join(per_ext.select("extension", own.alias("_own")), "extension", "left")
        .agg(
            F.sum("n").alias("_left"),
            F.sum(F.when(F.col("_own").isNotNull(), F.col("n") * F.col("_own"))).alias("_known"),
            F.sum(F.when(F.col("_own").isNull(), F.col("n"))).alias("_unknown"),
        )
    )
    # Two one-row aggregates side by side.
    both = totals.withColumns(
        {
            "_left": F.coalesce(work.select("_left").scalar(), F.lit(0)),
            "_known": F.coalesce(work.select("_known").scalar(), F.lit(0.0)),
            "_unknown": F.coalesce(work.select("_unknown").scalar(), F.lit(0)),
        }
    )
    rate = F.col("recent_completed") / float(window_minutes)
    weighted = F.when(F.col("_unknown") == 0, F.col("_known")).otherwise(F.col("_known") + F.col("_unknown") * F.col("_mean"))
    by_rate = F.when(rate > 0, F.col("_left") / rate * 60)
    eta = F.coalesce(F.when(F.col("_left") > 0, weighted), by_rate).cast("long")
    confidence = F.when(F.col("sample_size") >= 30, "high").when(F.col("sample_size") >= 10, "medium").otherwise("low")
    return both.select(
        "recent_completed", F.round(rate, 6).alias("rate_docs_per_min"), eta.alias("eta_seconds"),
        confidence.alias("confidence"), "sample_size",
    )


def format_eta(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds.isNull(), "unknown")
        .when(seconds < 60, F.format_string("%ds", seconds))
        .when(minutes < 60, F.format_string("~%d min", minutes))
        .otherwise(F.format_string("~%dh%02d", F.floor(minutes / 60), minutes % 60))
    )


def error_histogram(tasks: DataFrame, supported: tuple[str, ...] | None = None) -> DataFrame:
    """error_class, extension, n: the eight and four largest of each class."""
    from codicil.operators.retrieval import top_per_query

    known = supported or tuple({e for _, group in fv.READER_EXTENSIONS for e in group})
    ext = paths.extension(F.col("file_path"))
    message = F.lower(F.coalesce("error_message", F.lit("")))
    rejected = F.lit(False)
    for words in fv.UNSUPPORTED_ERROR_WORDS:
        rejected = rejected | F.contains(message, F.lit(words))
    unsupported = ext.isin(*fv.UNINDEXABLE_EXTENSIONS) | ~ext.isin(*known) | rejected
    counts = tasks.where("status = 'failed'").groupBy(
        F.when(unsupported, "unsupported_format").otherwise("processing_error").alias("error_class"),
        F.when(ext == "", "(no extension)").otherwise(ext).alias("extension"),
    ).agg(F.count("*").alias("n"))
    ranked = top_per_query(counts, 8, [F.desc("n"), F.asc("extension")], "error_class")
    return ranked.where((F.col("error_class") == "unsupported_format") | (F.col("rank") <= 4))


# --- failures ----------------------------------------------------------------------------


def failure_stats(failures: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """reason, n, retryable per reason and in total (grouping sets, one pass)."""
    reason = F.coalesce("reason", F.lit("unknown"))
    return (
        failures.withColumn("reason", reason).rollup("reason")
        .agg(F.count("*").alias("n"), F.count_if(F.coalesce("retry_count", F.lit(0)) < max_retries).alias("retryable"), F.grouping("reason").alias("_g"))
        .withColumn("reason", F.when(F.col("_g") == 1, "(all)").otherwise(F.col("reason"))).drop("_g")
    )


def worst_failures(failures: DataFrame, limit: int = 20, exhausted_only: bool = False, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    chosen = failures.where(F.col("retry_count") >= max_retries) if exhausted_only else failures
    return chosen.orderBy(F.desc("retry_count"), "path").limit(limit)


def recent_failures(failures: DataFrame, now: Column, days: int = fv.RETENTION_DAYS) -> DataFrame:
    """Failures younger than the retention; a missing stamp is dropped."""
    return failures.where(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))


def expired_trash(trash: DataFrame, now: Column, days: int = fv.RETENTION_DAYS) -> DataFrame:
    """Trash due for purge: the cutoff counts, and an unreadable stamp expires."""
    return trash.where(F.col("deleted_at").isNull() | (F.col("deleted_at") <= now - F.expr(f"INTERVAL {days} DAYS")))


# --- files, tables, batches ------------------------------------------------------------------


def unsupported_inventory(files: DataFrame, limit: int = 8, supported: tuple[str, ...] = fv.SCANNED_EXTENSIONS) -> DataFrame:
    """The most frequent extensions no reader takes, with their share of the total."""
    name = paths.name(F.col("path"))
    ext = extension_bucket(F.col("path"))
    counts = (
        files.where(~F.startswith(name, F.lit(".")) & ~ext.isin(*supported))
        .groupBy(ext.alias("extension")).agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), "extension").limit(limit)


def table_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, present: non-null count of every column in one pass."""
    names = columns or df.columns
    row = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in names])
    return row.select(
        "_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in names])).alias("_s")
    ).select("_s.column", F.col("_rows").alias("rows"), "_s.present")


def event_counts(events: DataFrame, tracked: list[str] | None = None) -> DataFrame:
    chosen = events.where(F.col("event_type").isin(*tracked)) if tracked else events
    return chosen.groupBy("event_type").agg(F.count("*").alias("n"))


def usage_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.agg(F.coalesce(F.sum(word_count(F.col(text))), F.lit(0)).alias("total_tokens"))


def batch_summary(results: DataFrame) -> DataFrame:
    """total, successful, skipped, failed and success_rate in percent (0 when empty)."""
    totals = results.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("successful", "skipped", "failed")]
    )
    return totals.withColumn("success_rate", F.round(F.coalesce(F.try_divide("successful", "total"), F.lit(0.0)) * 100, 6))


def ingest_summary(requests: DataFrame, listed: int = 10) -> DataFrame:
    """(queued, skipped, success) of a batch request; ``error`` is null for queued files."""
    return requests.agg(
        F.count_if(F.col("error").isNull()).alias("queued"), F.count_if(F.col("error").isNotNull()).alias("skipped")
    ).withColumn("success", F.col("skipped") == 0)


def first_errors(requests: DataFrame, listed: int = 10) -> DataFrame:
    return requests.where(F.col("error").isNotNull()).orderBy("pos").select("pos", "error").limit(listed)


def perf_summary(runs: DataFrame) -> DataFrame:
    """Averages of successful runs per backend, and per backend and prompt type, in one pass."""
    ok = F.col("success")
    return (
        runs.groupingSets([["backend"], ["backend", "prompt_type"]], "backend", "prompt_type")
        .agg(
            F.count("*").alias("runs"), F.count_if(ok).alias("successful_runs"),
            F.avg(F.when(ok, F.col("tokens_per_second"))).alias("avg_tps"),
            F.avg(F.when(ok, F.col("ttft_ms"))).alias("avg_ttft_ms"),
            F.grouping("prompt_type").alias("_g"),
        )
        .withColumn("prompt_type", F.when(F.col("_g") == 1, "(all)").otherwise(F.col("prompt_type"))).drop("_g")
    )


def backend_ratio(summary: DataFrame, left: str, right: str) -> DataFrame:
    """Speed ratio of two backends, rounded to two digits."""
    pick = lambda who, what: F.max(F.when((F.col("backend") == who) & (F.col("prompt_type") == "(all)"), F.col(what)))
    row = summary.agg(
        pick(left, "avg_tps").alias("_lt"), pick(right, "avg_tps").alias("_rt"),
        pick(left, "avg_ttft_ms").alias("_lf"), pick(right, "avg_ttft_ms").alias("_rf"),
    )
    positive = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.round(F.col(a) / F.col(b), 2))
    return row.select(positive("_lt", "_rt").alias("speedup_factor"), positive("_rf", "_lf").alias("ttft_improvement"))


def first_content_latency(chunks: DataFrame) -> DataFrame:
    """(request_id, first_ms): time from a request's start to its first non-empty chunk."""
    start = F.min("ts")
    first = F.min(F.when(F.coalesce("content", F.lit("")) != "", F.col("ts")))
    return chunks.groupBy("request_id").agg(
        F.round((F.unix_micros(first) - F.unix_micros(start)) / 1e3, 2).alias("first_ms")
    )


def stalls(tokens: DataFrame, gap_seconds: int = fv.STALL_SECONDS) -> DataFrame:
    """(request_id, bursts, longest_s): runs of tokens separated by more than the gap."""
    from pyspark.sql import Window

    order = Window.partitionBy("request_id").orderBy("ts")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6
    rows = tokens.withColumn("_gap", gap)
    return rows.groupBy("request_id").agg(
        (F.count_if(F.col("_gap") > gap_seconds) + 1).alias("bursts"), F.round(F.max("_gap"), 3).alias("longest_s")
    )


# --- pages of a document ---------------------------------------------------------------------


def page_profile(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text and image ratios of each document's pages (chars, has_image)."""
    chars, image = F.coalesce("chars", F.lit(0)), F.col("has_image")
    texty = chars > 10
    base = pages.groupBy(key).agg(
        F.count("*").alias("pages"),
        F.count_if(texty).alias("with_text"),
        F.count_if(image).alias("with_images"),
        F.coalesce(F.sum(F.when(texty, chars)), F.lit(0)).cast("long").alias("chars"),
        F.count_if(image & (chars < fv.OCR_SPARSE_PAGE_CHARS)).alias("sparse"),
    )
    n = F.col("pages")
    return base.select(
        key, "pages", "with_text", "with_images", "chars",
        # pages are joined by a blank line, which counts towards the text length
        (F.col("chars") + 2 * F.greatest(F.col("with_text") - 1, F.lit(0))).alias("text_length"),
        (F.col("with_text") / n).alias("text_coverage"),
        (F.col("chars") / n).alias("avg_chars"),
        (F.col("with_images") / n).alias("image_ratio"),
        (F.col("sparse") / n).alias("sparse_ratio"),
    )


def ocr_reason(profile: DataFrame, text: Column | None = None, languages: list[str] | None = None) -> DataFrame:
    """Adds ``ocr_reason``: scanned_sparse, low_text, missing_script, mojibake or null."""
    col = F.col
    scanned = (
        (col("text_length") < fv.OCR_MIN_TEXT_LENGTH)
        | (col("text_coverage") < fv.OCR_MIN_TEXT_COVERAGE)
        | (col("avg_chars") < fv.OCR_MIN_CHARS_PER_PAGE)
        | ((col("image_ratio") > 0.8) & (col("text_coverage") < 0.5))
        | (col("sparse_ratio") >= 0.5)
    )
    reason = F.when(scanned, F.when(col("sparse_ratio") >= 0.5, "scanned_sparse").otherwise("low_text"))
    if text is not None and languages:
        foreign = [s for s in expected_scripts(languages) if s != "LATIN"]
        if foreign:
            belt = (
                (F.length(text) > 0) & (col("image_ratio") >= 0.8)
                & (col("avg_chars") < fv.OCR_MISSING_SCRIPT_CEILING) & missing_script(text, foreign)
            )
            reason = reason.when(belt, "missing_script")
        reason = reason.when((F.length(text) > 0) & is_garbled(text, languages), "mojibake")
    return profile.withColumn("ocr_reason", reason)

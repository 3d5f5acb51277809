"""Event-time aggregates: throughput, counters, stalls, log metrics, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil import fixed_values as fv


def throughput(tasks: DataFrame, delay: str = "10 minutes", window: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """Finished items per sliding window of ``ts``."""
    return tasks.withWatermark("ts", delay).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("n"))


def event_counters(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per name and tumbling window."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def bursts(tokens: DataFrame, gap_seconds: int = fv.STALL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Token bursts of each request: a gap above the limit closes a burst (a stall)."""
    return tokens.withWatermark("ts", delay).groupBy(
        "request_id", F.session_window("ts", f"{gap_seconds} seconds").alias("burst")
    ).agg(F.count("*").alias("tokens"))


def log_metrics(logs: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Request count, failures and latency quantiles per window and backend of structured logs."""
    rows = logs.select(
        F.col("timestamp").alias("ts"), F.col("metadata.backend").alias("backend"),
        F.col("metadata.duration_ms").alias("duration_ms"), F.col("metadata.success").alias("success"),
    )
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", window), "backend").agg(
        F.count("*").alias("requests"),
        F.count_if(~F.col("success")).alias("failures"),
        F.avg("duration_ms").alias("mean_ms"),
        F.percentile_approx("duration_ms", [0.5, 0.95], 10000).alias("quantiles"),
    )


def without_duplicates(tasks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Work items without repeats of the same path and type inside the delay."""
    return tasks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_path", "task_type"])


def undiscovered(files: DataFrame, index: DataFrame) -> DataFrame:
    """Discovered files not in the (static) index."""
    return files.join(index.select("path"), "path", "left_anti")

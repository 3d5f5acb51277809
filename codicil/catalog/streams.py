"""Streaming jobs run over everything available, beside their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil import schemas
from codicil.catalog.base import query
from codicil.catalog.tables import table
from codicil.functions.turns import classify_turn
from codicil.session import work_folder
from codicil.sources import readers
from codicil.streaming import common, ingest, state, windows

ORDER = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING"
DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def _events(spark, sf):
    return common.file_stream(spark, sf, schemas.EVENT, "events.parquet")


def _micro(column):
    return F.unix_micros(column)


@query(
    "stream_ingest",
    "SELECT doc_id, trim(text) <> '' AS success FROM documents",
)
def _(spark, sf):
    docs = common.file_stream(spark, sf, DOCUMENT, "documents.parquet")
    folder = work_folder(spark, "ingest")
    ingest.ingest(docs.select("doc_id", F.col("text").alias("content"), F.col("n_chars").alias("version")), folder)
    return ingest.outcomes(spark, folder).select("doc_id", "success")


@query(
    "stream_throughput",
    """SELECT epoch_us(w) AS window_start, count(*) AS n FROM (SELECT unnest(list_transform(range(15), lambda i: time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE)) AS w
 FROM events WHERE event_type = 'purchase') GROUP BY w""",
)
def _(spark, sf):
    done = _events(spark, sf).where("event_type = 'purchase'")
    found = common.latest_updates(windows.throughput(done), ["window"])
    return found.select(_micro("window.start").alias("window_start"), "n")


@query("stream_event_counters", "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    found = common.latest_updates(windows.event_counters(_events(spark, sf)), ["window", "event_type"])
    return found.select(_micro("window.start").alias("window_start"), "event_type", "n")


@query(
    "stream_bursts",
    """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 90000000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
 SELECT user_id AS request_id, epoch_us(min(ts)) AS burst_start, count(*) AS tokens FROM s GROUP BY user_id, s
 HAVING epoch_us(max(ts)) + 90000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""",
)
def _(spark, sf):
    tokens = _events(spark, sf).select(F.col("user_id").alias("request_id"), "ts")
    target = common.drain(windows.bursts(tokens).select("request_id", _micro("burst.start").alias("burst_start"), "tokens"))
    return spark.read.schema("request_id long, burst_start long, tokens long").parquet(target)


def _log_folder(spark, sf):
    """Events as JSON log lines."""
    lines = table(spark, sf, "events").select(
        F.to_json(F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("perf").alias("module"),
            F.lit("Chat completed").alias("message"),
            F.struct(
                F.col("event_type").alias("backend"), F.get_json_object("props", "$.k").cast("double").alias("duration_ms"),
                (F.col("event_type") != "error").alias("success"),
            ).alias("metadata"),
        )).alias("value")
    )
    folder = work_folder(spark, "log")
    lines.write.text(folder)
    return folder


@query(
    "logs",
    """SELECT event_type AS backend, count(*) AS lines, count(*) FILTER (WHERE event_type = 'error') AS failures,
 round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 3) AS total_ms, 0 AS unreadable, epoch_us(max(ts)) AS last FROM events GROUP BY event_type
 UNION ALL SELECT NULL, 1, 0, NULL, 1, NULL""",
)
def _(spark, sf):
    """The same log read as a table, with one line that cannot be read."""
    folder = _log_folder(spark, sf)
    spark.range(1).select(F.lit("{not json").alias("value")).write.mode("append").text(folder)
    return readers.read_logs(spark, folder).groupBy(F.col("metadata.backend").alias("backend")).agg(
        F.count("*").alias("lines"), F.count_if(~F.col("metadata.success")).alias("failures"),
        F.round(F.sum("metadata.duration_ms"), 3).alias("total_ms"), F.count("_corrupt_record").alias("unreadable"), _micro(F.max("timestamp")).alias("last"),
    )


@query(
    "stream_log_metrics",
    """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type AS backend, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures,
 avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean_ms FROM events GROUP BY ALL""",
)
def _(spark, sf):
    """Events rewritten as JSON log lines by Spark, then tailed as a log."""
    folder = _log_folder(spark, sf)
    logs = common.file_stream(spark, folder, schemas.LOG_LINE, fmt="json")
    found = common.latest_updates(windows.log_metrics(logs).drop("quantiles"), ["window", "backend"])
    return found.select(_micro("window.start").alias("window_start"), "backend", "requests", "failures", "mean_ms")


@query(
    "stream_without_duplicates",
    "SELECT DISTINCT '/u/' || user_id AS file_path, event_type AS task_type FROM events",
)
def _(spark, sf):
    """A delay longer than the table's month: each path and type is let through once."""
    work = _events(spark, sf).select(F.concat(F.lit("/u/"), "user_id").alias("file_path"), F.col("event_type").alias("task_type"), "ts")
    target = common.drain(windows.without_duplicates(work, "60 days").select("file_path", "task_type"))
    return spark.read.schema("file_path string, task_type string").parquet(target)


@query("stream_undiscovered", "SELECT '/d/' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs = common.file_stream(spark, sf, DOCUMENT, "documents.parquet").select(F.concat(F.lit("/d/"), "doc_id").alias("path"))
    index = table(spark, sf, "labels").select(F.concat(F.lit("/d/"), "doc_id").alias("path"))
    return spark.read.schema("path string").parquet(common.drain(windows.undiscovered(docs, index)))


# Events of a task table: signup queues, click starts, purchase completes, error fails, view retries.
_TASK_EVENT = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
 WHEN 'error' THEN 'failed' ELSE 'retry' END"""


@query(
    "stream_task_states",
    """SELECT CAST(user_id AS VARCHAR) AS id, count(*) FILTER (WHERE event_type = 'error')::INT AS retry_count, count(*) AS events_seen FROM events GROUP BY user_id""",
)
def _(spark, sf):
    """Retry count and number of transitions of each task."""
    work = _events(spark, sf).selectExpr("CAST(user_id AS STRING) AS id", "ts", f"{_TASK_EVENT} AS event", "event_id AS seq")
    found = common.latest_updates(state.task_states(work, stuck_seconds=10**9), ["id"])
    return found.select("id", "retry_count", F.col("version").alias("events_seen"))


@query("stream_retention")
def _(spark, sf):
    """Errors delete, sign-ups restore; one day of retention.  The tests replay it row by row."""
    work = _events(spark, sf).where("event_type IN ('signup', 'error')").selectExpr(
        "'/u/' || user_id AS path", "ts", "CASE event_type WHEN 'signup' THEN 'restored' ELSE 'deleted' END AS event"
    )
    target = common.drain(state.retention(work, days=1))
    return spark.read.schema("path string, status string, at timestamp").parquet(target).select("path", _micro("at").alias("at"))


@query(
    "stream_failure_memory",
    """WITH e AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('error', 'view', 'purchase', 'click')),
 ok AS (SELECT user_id, max(ts) AS ts FROM e WHERE event_type = 'purchase' GROUP BY user_id)
 SELECT '/u/' || e.user_id AS path, epoch_us(max(e.ts) FILTER (WHERE event_type = 'error' AND (ok.ts IS NULL OR e.ts > ok.ts))) AS last_failure
 FROM e LEFT JOIN ok ON e.user_id = ok.user_id GROUP BY e.user_id HAVING last_failure IS NOT NULL""",
)
def _(spark, sf):
    """Errors fail, views retry, clicks modify, purchases succeed: files still remembered."""
    work = _events(spark, sf).where("event_type IN ('error', 'view', 'purchase', 'click')").selectExpr(
        "'/u/' || user_id AS path", "ts", "event_id AS seq", "event_type AS reason",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'retried' WHEN 'purchase' THEN 'succeeded' ELSE 'modified' END AS event",
    )
    found = common.latest_updates(state.failure_memory(work, days=365), ["path"])
    return found.where("live").select("path", _micro("ts").alias("last_failure"))


@query("stream_referents")
def _(spark, sf):
    """User turns as a stream; a turn's own opener decides its kind, its first long word names a document."""
    rows = common.file_stream(spark, sf, schemas.TURN, "conversations.parquet").where("role = 'user'")
    text = F.col("text")
    shaped = rows.select(
        "conv_id", "turn",
        classify_turn(F.when(F.length(text) % 3 == 0, F.concat(F.lit("il "), text)).when(F.length(text) % 7 == 0, F.lit("le premier")).otherwise(text)).alias("kind"),
        F.when(F.length(text) % 2 == 0, F.regexp_extract(text, r"\p{L}{6,}", 0)).alias("named_path"),
        F.regexp_extract(text, r"\p{L}{5,}", 0).alias("fallback_path"),
    )
    return spark.read.schema(state.REFERENT_OUTPUT).parquet(common.drain(state.referents(shaped)))

"""Statistics over tasks, failures, events, files and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.catalog.base import query
from codicil.catalog.tables import CORPUS, FAILURES, FILES, SNAPSHOTS, TASKS, corpus, failures, files, snapshots, table, tasks
from codicil.functions import text
from codicil.operators import audit, filters, retrieval
from codicil.operators import tasks as ops


@query(
    "task_stats",
    f"WITH {TASKS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in fv.TASK_STATUSES) + " FROM tasks",
)
def _(spark, sf):
    return ops.task_stats(tasks(spark, sf))


@query("tasks_by_type", f"WITH {TASKS} SELECT task_type, count(*) AS n FROM tasks GROUP BY task_type")
def _(spark, sf):
    return ops.tasks_by_type(tasks(spark, sf))


@query("pending_by_priority", f"WITH {TASKS} SELECT priority, count(*) AS n FROM tasks WHERE status = 'pending' GROUP BY priority")
def _(spark, sf):
    return ops.pending_by_priority(tasks(spark, sf))


@query(
    "rank_pending",
    f"""WITH {TASKS} SELECT id, priority, added_at::VARCHAR AS added FROM tasks WHERE status = 'pending'
 ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, added_at, id LIMIT 100""",
)
def _(spark, sf):
    top = ops.rank_pending(tasks(spark, sf), 100)
    return top.select("id", "priority", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added"))


@query("list_tasks", f"WITH {TASKS} SELECT id, status FROM tasks WHERE status = 'failed' ORDER BY added_at DESC, id DESC LIMIT 50")
def _(spark, sf):
    return ops.list_tasks(tasks(spark, sf), "failed").select("id", "status")


@query(
    "retry_failed",
    f"""WITH {TASKS} SELECT id, CASE WHEN status = 'failed' AND retry_count < 5 THEN 'pending' ELSE status END AS status,
 CASE WHEN status = 'failed' AND retry_count < 5 THEN NULL ELSE error_message END AS error_message FROM tasks""",
)
def _(spark, sf):
    return ops.retry_failed(tasks(spark, sf), 5).select("id", "status", "error_message")


@query(
    "reset_stuck_tasks",
    f"""WITH {TASKS} SELECT id, CASE WHEN status = 'processing' AND date_diff('second', started_at, TIMESTAMP '1999-06-01') > 600
 THEN 'pending' ELSE status END AS status FROM tasks""",
)
def _(spark, sf):
    return ops.reset_stuck(tasks(spark, sf), F.lit("1999-06-01").cast("timestamp")).select("id", "status")


@query(
    "duration_stats",
    f"""WITH {TASKS}, d AS (SELECT regexp_extract(file_path, '\\.[a-z]+$') AS extension, epoch(completed_at) - epoch(started_at) AS d
 FROM tasks WHERE status = 'completed')
 SELECT extension, count(*) AS n, avg(d) AS mean_s, min(d) AS min_s, max(d) AS max_s FROM d WHERE d > 0 GROUP BY extension""",
)
def _(spark, sf):
    return ops.duration_stats(tasks(spark, sf))


# Twelve years in minutes: the task table spans years, a live one spans the last quarter hour.
_ETA_MINUTES = 60 * 24 * 900


def _eta(window: int, now: str) -> str:
    return f"""WITH {SNAPSHOTS}, finish AS (SELECT l_orderkey, max(l_shipdate) AS finished FROM lineitem GROUP BY l_orderkey), {TASKS.split(', finish AS', 1)[1].split('),', 1)[1].strip()},
 todo AS (SELECT regexp_extract(path, '\\.[a-z]+$') AS extension, count(*) AS n FROM files WHERE path NOT IN (SELECT path FROM cur) GROUP BY 1),
 recent AS (SELECT regexp_extract(file_path, '\\.[a-z]+$') AS extension, epoch(completed_at) - epoch(started_at) AS d FROM tasks
 WHERE status = 'completed' AND completed_at >= TIMESTAMP '{now}' - INTERVAL {window} MINUTE),
 ext AS (SELECT extension, count(*) FILTER (WHERE d > 0) AS k, avg(d) FILTER (WHERE d > 0) AS m FROM recent GROUP BY extension),
 tot AS (SELECT count(*) AS c, count(*) FILTER (WHERE d > 0) AS s, avg(d) FILTER (WHERE d > 0) AS g FROM recent),
 eta AS (SELECT sum(n) AS n, sum(n * CASE WHEN k >= 3 THEN m ELSE g END) AS w FROM todo LEFT JOIN ext USING (extension), tot)
 SELECT c AS recent_completed, round(c / {window}.0, 6) AS rate_docs_per_min, floor(coalesce(w, n / (c / {window}.0) * 60))::BIGINT AS eta_seconds,
 CASE WHEN s >= 30 THEN 'high' WHEN s >= 10 THEN 'medium' ELSE 'low' END AS confidence, s AS sample_size FROM tot, eta"""


@query("throughput_eta", _eta(_ETA_MINUTES, "2001-11-01"))
def _(spark, sf):
    _, indexed = snapshots(spark, sf)
    todo = files(spark, sf).join(indexed, "path", "left_anti")
    remaining = todo.groupBy(ops.extension_bucket(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))
    return ops.throughput_eta(tasks(spark, sf), remaining, F.lit("2001-11-01").cast("timestamp"), _ETA_MINUTES)


@query(
    "format_eta",
    f"""WITH {TASKS}, s AS (SELECT id, (epoch(completed_at) - epoch(started_at))::BIGINT AS s FROM tasks WHERE completed_at > started_at)
 SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN '~' || (s // 60) || ' min' ELSE '~' || (s // 3600) || 'h'
 || lpad(((s // 60) % 60)::VARCHAR, 2, '0') END AS eta FROM s""",
)
def _(spark, sf):
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    return tasks(spark, sf).where("completed_at > started_at").select("id", ops.format_eta(seconds).alias("eta"))


@query(
    "error_histogram",
    f"""WITH {TASKS}, f AS (SELECT regexp_extract(file_path, '\\.[a-z]+$') AS extension, lower(coalesce(error_message, '')) AS m FROM tasks WHERE status = 'failed'),
 c AS (SELECT CASE WHEN extension IN ('.docx', '.xyz') OR contains(m, 'no extractor') THEN 'unsupported_format' ELSE 'processing_error' END AS error_class,
 extension, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY error_class ORDER BY n DESC, extension) AS rank FROM c)
 SELECT error_class, extension, n, rank::INT AS rank FROM r WHERE rank <= CASE error_class WHEN 'unsupported_format' THEN 8 ELSE 4 END""",
)
def _(spark, sf):
    return ops.error_histogram(tasks(spark, sf))


@query(
    "failure_stats",
    f"""WITH {TASKS}, {FAILURES} SELECT coalesce(reason, 'unknown') AS reason, count(*) AS n, count(*) FILTER (WHERE retry_count < 5) AS retryable FROM failures GROUP BY 1
 UNION ALL SELECT '(all)', count(*), count(*) FILTER (WHERE retry_count < 5) FROM failures""",
)
def _(spark, sf):
    return ops.failure_stats(failures(spark, sf), 5)


@query("worst_failures", f"WITH {TASKS}, {FAILURES} SELECT path, retry_count FROM failures WHERE retry_count >= 3 ORDER BY retry_count DESC, path LIMIT 20")
def _(spark, sf):
    return ops.worst_failures(failures(spark, sf), 20, True).select("path", "retry_count")


@query("recent_failures", f"WITH {TASKS}, {FAILURES} SELECT path FROM failures WHERE ts > TIMESTAMP '2001-06-30' - INTERVAL 30 DAY")
def _(spark, sf):
    return ops.recent_failures(failures(spark, sf), F.lit("2001-06-30").cast("timestamp")).select("path")


@query(
    "unsupported_inventory",
    """SELECT CASE WHEN ext = '' THEN '(noext)' ELSE ext END AS extension, count(*) AS n FROM (SELECT lower(regexp_extract(split_part(url, '/', -1),
 '[^.].*?(\\.[^.]+)$', 1)) AS ext FROM pages) WHERE ext NOT IN ('.html', '.htm') GROUP BY 1 ORDER BY n DESC, extension LIMIT 8""",
)
def _(spark, sf):
    return ops.unsupported_inventory(table(spark, sf, "pages").select(F.col("url").alias("path")))


@query(
    "table_stats",
    "SELECT unnest(['doc_id', 'text', 'lang']) AS \"column\", unnest([c, c, c]) AS rows, unnest([a, b, d]) AS present FROM (SELECT count(*) AS c, count(doc_id) AS a, count(nullif(text, '')) AS b, count(nullif(lang, 'de')) AS d FROM documents)",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.nullif("text", F.lit("")).alias("text"), F.nullif("lang", F.lit("de")).alias("lang")
    )
    return ops.table_stats(docs)


@query("event_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY event_type")
def _(spark, sf):
    return ops.event_counts(table(spark, sf, "events"), ["click", "error", "view"])


@query("usage_tokens", r"SELECT sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))::BIGINT AS total_tokens FROM documents")
def _(spark, sf):
    return ops.usage_tokens(table(spark, sf, "documents"))


_OUTCOMES = "CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'successful' END"


@query(
    "batch_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS successful, count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) * 100, 6) AS success_rate FROM orders""",
)
def _(spark, sf):
    return ops.batch_summary(table(spark, sf, "orders").selectExpr(f"{_OUTCOMES} AS outcome"))


_REQUESTS = f"""{FILES}, req AS (SELECT c_custkey AS pos, CASE WHEN c_acctbal < 0 THEN 'File not found: ' || path WHEN NOT starts_with(path, '/A')
 THEN 'Path outside allowed roots: ' || path END AS error FROM files)"""


def _requests(spark, sf):
    path = F.col("path")
    error = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("File not found: "), path)).when(
        ~F.startswith(path, F.lit("/A")), F.concat(F.lit("Path outside allowed roots: "), path)
    )
    return files(spark, sf).select(F.col("c_custkey").alias("pos"), error.alias("error"))


@query(
    "ingest_summary",
    f"WITH {_REQUESTS} SELECT count(*) FILTER (WHERE error IS NULL) AS queued, count(*) FILTER (WHERE error IS NOT NULL) AS skipped, count(error) = 0 AS success FROM req",
)
def _(spark, sf):
    return ops.ingest_summary(_requests(spark, sf))


@query("first_errors", f"WITH {_REQUESTS} SELECT pos, error FROM req WHERE error IS NOT NULL ORDER BY pos LIMIT 10")
def _(spark, sf):
    return ops.first_errors(_requests(spark, sf))


_RUNS = "runs AS (SELECT event_type AS backend, 'k' || (CAST(json_extract_string(props, '$.k') AS INT) // 25) AS prompt_type, CAST(json_extract_string(props, '$.k') AS INT) AS tps, 3 * CAST(json_extract_string(props, '$.k') AS INT) AS ttft, value >= 5 AS ok FROM events)"


def _runs(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("backend"), F.concat(F.lit("k"), F.floor(k / 25)).alias("prompt_type"),
        k.alias("tokens_per_second"), (k * 3).alias("ttft_ms"), (F.col("value") >= 5).alias("success"),
    )


_PERF = f"""WITH {_RUNS}, perf AS (SELECT backend, coalesce(prompt_type, '(all)') AS prompt_type, count(*) AS runs, count(*) FILTER (WHERE ok) AS successful_runs,
 avg(tps) FILTER (WHERE ok) AS avg_tps, avg(ttft) FILTER (WHERE ok) AS avg_ttft_ms FROM runs GROUP BY GROUPING SETS ((backend), (backend, prompt_type)))"""


@query("perf_summary", f"{_PERF} SELECT * FROM perf")
def _(spark, sf):
    return ops.perf_summary(_runs(spark, sf))


@query(
    "backend_ratio",
    f"""{_PERF}, a AS (SELECT * FROM perf WHERE backend = 'click' AND prompt_type = '(all)'), b AS (SELECT * FROM perf WHERE backend = 'view' AND prompt_type = '(all)')
 SELECT round(a.avg_tps / b.avg_tps, 2) AS speedup_factor, round(b.avg_ttft_ms / a.avg_ttft_ms, 2) AS ttft_improvement FROM a, b""",
)
def _(spark, sf):
    return ops.backend_ratio(ops.perf_summary(_runs(spark, sf)), "click", "view")


_STREAMED = "SELECT user_id AS request_id, ts, CASE WHEN event_type IN ('signup', 'error') THEN '' ELSE event_type END AS content FROM events"


@query(
    "first_content_latency",
    f"""SELECT request_id, floor((epoch_us(min(ts) FILTER (WHERE content <> '')) - epoch_us(min(ts)) + 5) / 10) / 100 AS first_ms FROM ({_STREAMED}) GROUP BY request_id""",
)
def _(spark, sf):
    content = F.when(F.col("event_type").isin("signup", "error"), "").otherwise(F.col("event_type"))
    return ops.first_content_latency(table(spark, sf, "events").select(F.col("user_id").alias("request_id"), "ts", content.alias("content")))


@query(
    "stalls",
    """WITH g AS (SELECT user_id AS request_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events)
 SELECT request_id, count(*) FILTER (WHERE gap > 90) + 1 AS bursts, round(max(gap), 3) AS longest_s FROM g GROUP BY request_id""",
)
def _(spark, sf):
    return ops.stalls(table(spark, sf, "events").select(F.col("user_id").alias("request_id"), "ts"))


# --- calibration: distinct-word share of labelled documents ------------------------------------

_SCORED = r"""scored AS (SELECT CASE quality WHEN 1 THEN 'supported' ELSE 'offtopic' END AS label, round(len(list_distinct(t)) / greatest(len(t), 1), 6) AS score
 FROM (SELECT quality, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents JOIN labels USING (doc_id)))"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    share = F.round(F.size(F.array_distinct("t")) / F.greatest(F.size("t"), F.lit(1)), 6)
    label = F.when(F.col("quality") == 1, "supported").otherwise("offtopic")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(label.alias("label"), share.alias("score"))


@query(
    "label_profile",
    f"WITH {_SCORED} SELECT label, count(*) AS n, round(min(score), 9) AS lo, round(median(score), 9) AS med, round(max(score), 9) AS hi, round(avg(score), 9) AS mean FROM scored GROUP BY label",
)
def _(spark, sf):
    return audit.label_profile(_scored(spark, sf))


@query(
    "threshold_sweep",
    f"""WITH {_SCORED}, cuts AS (SELECT round(0.2 + i * 0.05, 2) AS threshold FROM range(11) r(i))
 SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE label = 'supported' AND score < threshold) AS false_positives,
 count(*) FILTER (WHERE label = 'offtopic' AND score < threshold) AS detections,
 round(count(*) FILTER (WHERE label = 'offtopic' AND score < threshold) / count(*) FILTER (WHERE label = 'offtopic')
 - count(*) FILTER (WHERE label = 'supported' AND score < threshold) / count(*) FILTER (WHERE label = 'supported'), 6) AS youden_j
 FROM scored, cuts GROUP BY threshold""",
)
def _(spark, sf):
    return audit.threshold_sweep(_scored(spark, sf), "supported", "offtopic")


@query(
    "recommended_cut",
    f"""WITH {_SCORED}, b AS (SELECT min(score) FILTER (WHERE label = 'supported') AS lo, max(score) FILTER (WHERE label = 'offtopic') AS hi FROM scored)
 SELECT round(CASE WHEN hi < lo THEN (hi + lo) / 2 ELSE lo END, 2) AS cut FROM b""",
)
def _(spark, sf):
    return audit.recommended_cut(_scored(spark, sf), "supported", "offtopic")


# --- sorts and pages ------------------------------------------------------------------------------


@query("sort_documents", f"WITH {CORPUS} SELECT doc_id, n_chars AS file_size FROM corpus ORDER BY file_size DESC, doc_id LIMIT 25")
def _(spark, sf):
    rows = corpus(spark, sf).select("doc_id", F.col("n_chars").alias("file_size"))
    return filters.sort_documents(rows, "file_size", tie="doc_id").limit(25)


@query("page_of_results", "SELECT event_id, value AS score FROM events ORDER BY score DESC, event_id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return filters.page(table(spark, sf, "events").select("event_id", F.col("value").alias("score")), 20, 40, "event_id")


_HITS = "hits AS (SELECT user_id AS query_id, event_id AS chunk_id, CAST(json_extract_string(props, '$.k') AS INT) AS doc_id, value / 20 AS score FROM events)"


def _hits(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"),
        F.get_json_object("props", "$.k").cast("int").alias("doc_id"), (F.col("value") / 20).alias("score"),
    )


@query(
    "top_chunks",
    f"WITH {_HITS} SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM hits WHERE score >= 0.3 QUALIFY rank <= 5",
)
def _(spark, sf):
    return retrieval.top_chunks(_hits(spark, sf)).select("query_id", "chunk_id", "score", "rank")


@query(
    "unique_docs",
    f"WITH {_HITS} SELECT query_id, count(*) AS chunks, count(DISTINCT doc_id) AS unique_docs FROM hits WHERE score >= 0.3 GROUP BY query_id",
)
def _(spark, sf):
    return retrieval.unique_docs(filters.filter_score(_hits(spark, sf)))



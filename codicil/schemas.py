"""Schemas of the tables the operators exchange, in DDL form."""

DOCUMENT = """id STRING, path STRING, title STRING, content STRING, language STRING, category STRING,
 file_type STRING, file_size BIGINT, mtime DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP,
 has_content BOOLEAN, metadata MAP<STRING,STRING>, vector ARRAY<FLOAT>"""
CHUNK = """chunk_id STRING, doc_id STRING, path STRING, title STRING, content STRING, chunk_index INT,
 total_chunks INT, offset_start INT, offset_end INT"""
FILE_INFO = "path STRING, size BIGINT, mtime DOUBLE, sha256 STRING, extension STRING"
TASK = """id STRING, file_path STRING, task_type STRING, priority STRING, status STRING, added_at TIMESTAMP,
 started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING, retry_count INT"""
FAILURE = """path STRING, error STRING, reason STRING, ts TIMESTAMP, retry_count INT, file_size BIGINT,
 sha256 STRING, last_retry TIMESTAMP"""
LOG_LINE = """timestamp TIMESTAMP, level STRING, module STRING, message STRING,
 metadata STRUCT<request_id: STRING, duration_ms: DOUBLE, ttft_ms: DOUBLE, model: STRING, backend: STRING,
 eval_count: BIGINT, eval_duration_ns: BIGINT, success: BOOLEAN>, exception STRING, _corrupt_record STRING"""
EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
TURN = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"

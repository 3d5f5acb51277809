"""Streams over several files equal their batch twins, replayed row by row."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codicil.operators import conversation
from codicil.session import work_folder
from codicil.streaming import common, ingest, state

START = dt.datetime(2024, 1, 1)


def staged(spark, rows, schema, files=4):
    """Rows written in order as several files, read back as a stream of one file at a time."""
    folder = work_folder(spark, "in")
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return common.file_stream(spark, folder, schema, max_files=1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_task_states(spark):
    rows = [
        ("a", at(0), "pending", 0), ("b", at(0), "pending", 1), ("a", at(1), "processing", 2), ("b", at(2), "processing", 3),
        ("a", at(3), "failed", 4), ("a", at(4), "retry", 5), ("b", at(5), "completed", 6), ("a", at(6), "processing", 7),
        ("c", at(7), "cancelled", 8), ("d", at(300), "pending", 9), ("d", at(301), "processing", 10), ("d", at(302), "failed", 11),
    ]
    found = common.latest_updates(state.task_states(staged(spark, rows, "id string, ts timestamp, event string, seq long")), ["id"])
    got = {r["id"]: (r["status"], r["retry_count"]) for r in found.collect()}
    # a has been processing for hours when the watermark passes, so it is pending again
    assert got == {"a": ("pending", 1), "b": ("completed", 0), "c": ("cancelled", 0), "d": ("failed", 1)}


def test_retention(spark):
    day = 24 * 60
    rows = [
        ("/a", at(0), "deleted"), ("/b", at(10), "deleted"), ("/c", at(20), "deleted"), ("/b", at(5 * day), "restored"),
        ("/a", at(6 * day), "deleted"), ("/d", at(40 * day), "deleted"), ("/e", at(80 * day), "deleted"),
    ]
    out = common.drain(state.retention(staged(spark, rows, "path string, ts timestamp, event string", 7)))
    got = spark.read.schema("path string, status string, at timestamp").parquet(out)
    assert sorted((r["path"], r["at"]) for r in got.collect()) == [
        ("/a", at(30 * day)), ("/c", at(20 + 30 * day)), ("/d", at(70 * day))
    ]


def test_failure_memory(spark):
    day = 24 * 60
    rows = [
        ("/a", at(0), "failed", "encoding", 0), ("/a", at(1), "retried", None, 1), ("/a", at(2), "retried", None, 2),
        ("/b", at(3), "failed", "empty", 3), ("/b", at(4), "succeeded", None, 4), ("/c", at(5), "failed", "x", 5),
        ("/c", at(6), "retried", None, 6), ("/c", at(7), "modified", None, 7), ("/a", at(35 * day), "failed", "y", 8), ("/z", at(36 * day), "failed", "z", 9),
    ]
    found = common.latest_updates(state.failure_memory(staged(spark, rows, "path string, ts timestamp, event string, reason string, seq long", 5)), ["path"])
    got = {r["path"]: (r["live"], r["reason"], r["retry_count"]) for r in found.collect()}
    assert got == {"/a": (True, "y", 0), "/b": (False, None, 0), "/c": (False, None, 0), "/z": (True, "z", 0)}


def test_referents_equal_the_batch_fold(spark):
    texts = ["Parlons du contrat de la grande société", "il dit quoi ?", "le premier", "Un autre sujet pour toute la société", "et ce document ?", "le dernier"]
    rows = [(c, t, texts[(c + t) % 6], f"/n{c}{t}" if (c * t) % 3 == 1 else None, f"/f{t % 2}") for t in range(12) for c in range(5)]
    schema = "conv_id long, turn long, text string, named_path string, fallback_path string"
    from codicil.functions.turns import classify_turn

    stream = staged(spark, rows, schema, 6).select("conv_id", "turn", classify_turn(F.col("text")).alias("kind"), "named_path", "fallback_path")
    live = spark.read.schema(state.REFERENT_OUTPUT).parquet(common.drain(state.referents(stream)))
    batch = conversation.referent_stack(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, live.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_ingest_keeps_one_state_per_document(spark):
    rows = [(1, "first text", 1), (2, "", 1), (3, "third " * 600, 1), (1, "second text", 2), (3, "short", 2)]
    folder = work_folder(spark, "ingest")
    ingest.ingest(staged(spark, rows, "doc_id long, content string, version long", 5), folder)
    docs = {r["doc_id"]: r["content"] for r in ingest.documents(spark, folder).collect()}
    assert docs == {1: "second text", 2: "", 3: "short"}
    assert sorted(r["content"] for r in ingest.chunks(spark, folder).collect()) == ["second text", "short"]
    assert {r["doc_id"]: r["success"] for r in ingest.outcomes(spark, folder).collect()} == {1: True, 2: False, 3: True}


def test_registered_retention_replay(spark):
    """The registered stream against a plain loop over the same events."""
    from codicil.catalog.base import QUERIES, load_all

    load_all()
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_type IN ('signup', 'error')").orderBy("ts").toPandas()
    day, want, deleted = pd.Timedelta(days=1), [], {}
    for user, ts, kind in zip(events["user_id"], events["ts"], events["event_type"]):
        if user in deleted and ts >= deleted[user] + day:
            want.append((f"/u/{user}", deleted.pop(user) + day))
        if kind == "signup":
            deleted.pop(user, None)
        else:
            deleted.setdefault(user, ts)
    horizon = events["ts"].max() - pd.Timedelta(hours=1)
    want += [(f"/u/{u}", d + day) for u, d in deleted.items() if d + day <= horizon]
    got = [(r["path"], pd.Timestamp(r["at"], unit="us")) for r in QUERIES["stream_retention"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["stream_event_counters", "stream_bursts"])
def test_streams_against_sql(spark, name):
    from codicil.catalog.base import ORACLES, QUERIES, load_all
    from tests import oracle

    load_all()
    sf = "/root/testdata/sf0.001"
    ok, message, _ = oracle.compare(spark, sf, oracle.connect(sf), name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_tables_stored_as_folders(spark):
    """A table may be one file or a folder of parts: a stream reads all of either (F6, F9)."""
    base = work_folder(spark, "tables")
    rows = spark.range(6).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'web' AS source", "6L AS n_chars")
    rows.repartition(3).write.parquet(f"{base}/documents.parquet")
    rows.where("doc_id < 2").selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{base}/labels.parquet")
    from __spark_entry__ import queries

    assert sorted(r["path"] for r in queries()["stream_undiscovered"](spark, base).collect()) == [f"/d/{i}" for i in range(2, 6)]
    assert sorted((r["doc_id"], r["success"]) for r in queries()["stream_ingest"](spark, base).collect()) == [(i, True) for i in range(6)]

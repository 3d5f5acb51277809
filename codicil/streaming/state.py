"""Keyed state: tasks, conversations, trash and failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codicil import fixed_values as fv
from codicil.operators.conversation import ReferentStack



def _micros(stamp) -> int:
    return int(pd.Timestamp(stamp).value // 1000)


def _stamp(micros: int | None):
    return None if micros is None else pd.Timestamp(micros, unit="us")


TASK_OUTPUT = "id string, status string, started_at timestamp, completed_at timestamp, retry_count int, version long"
_TASK_STATE = "status string, started long, completed long, retries int, version long"


def task_states(events: DataFrame, delay: str = "1 hour", stuck_seconds: int = fv.STUCK_SECONDS,
                max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """Current state of each task from its events (id, ts, event, error).

    Events are pending, processing, completed, failed, cancelled and retry.  A
    failure raises the retry count; retry returns a task to pending below the
    ceiling.  A task processing for longer than the limit in event time goes
    back to pending.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, completed, retries, version = state.get if state.exists else ("new", None, None, 0, 0)
        if state.hasTimedOut:
            if status == "processing":
                status, started, version = "pending", None, version + 1
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            for ts, event in zip(rows["ts"], rows["event"]):
                at = _micros(ts)
                if status == "processing" and started is not None and at - started > stuck_seconds * 1_000_000:
                    status, started = "pending", None
                if event == "retry":
                    status = "pending" if status == "failed" and retries < max_retries else status
                else:
                    status = event
                    started = at if event == "processing" else started
                    completed = at if event in ("completed", "failed") else completed
                    retries += event == "failed"
                version += 1
        state.update((status, started, completed, int(retries), int(version)))
        if status == "processing" and started is not None:
            due = started // 1000 + stuck_seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"id": [key[0]], "status": [status], "started_at": [_stamp(started)], "completed_at": [_stamp(completed)],
             "retry_count": [int(retries)], "version": [int(version)]}
        )

    return (
        events.withWatermark("ts", delay).groupBy("id")
        .applyInPandasWithState(step, TASK_OUTPUT, _TASK_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )


REFERENT_OUTPUT = "conv_id long, turn long, turn_kind string, action string, referent string, stack_size int"


def referents(turns: DataFrame) -> DataFrame:
    """The referent of each user turn of live conversations.

    ``turns`` holds conv_id, turn, kind, named_path and fallback_path; the
    stack of a conversation is kept as state between micro-batches.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = ReferentStack(list(state.get[0]) if state.exists else [])
        rows = []
        for turn, kind, named, fallback in (
            pd.concat(list(batches)).sort_values("turn")[["turn", "kind", "named_path", "fallback_path"]].itertuples(index=False, name=None)
        ):
            named = named if isinstance(named, str) else None
            fallback = fallback if isinstance(fallback, str) else None
            action, referent = stack.decide(kind, named)
            rows.append((key[0], turn, kind, action, referent, len(stack.entries)))
            stack.apply(kind, named, fallback)
        state.update((stack.entries,))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "turn_kind", "action", "referent", "stack_size"])

    return turns.groupBy("conv_id").applyInPandasWithState(
        step, REFERENT_OUTPUT, "entries array<string>", "append", GroupStateTimeout.NoTimeout
    )


EXPIRY_OUTPUT = "path string, status string, at timestamp"


def retention(events: DataFrame, days: int = fv.RETENTION_DAYS, delay: str = "1 hour") -> DataFrame:
    """Trash state from deleted and restored events (path, ts, event).

    A deletion not restored within the retention expires once the watermark
    passes its due time; a second deletion does not move the stamp.
    """
    span = days * 86_400_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deleted = state.get[0] if state.exists else None
        rows = []
        if state.hasTimedOut:
            rows.append((key[0], "expired", _stamp(deleted + span)))
            state.remove()
            deleted = None
        else:
            frame = pd.concat(list(batches)).sort_values("ts")
            for ts, event in zip(frame["ts"], frame["event"]):
                at = _micros(ts)
                if deleted is not None and at >= deleted + span:
                    rows.append((key[0], "expired", _stamp(deleted + span)))
                    deleted = None
                if event == "restored":
                    deleted = None
                elif deleted is None:
                    deleted = at
            if deleted is None:
                if state.exists:
                    state.remove()
            else:
                state.update((deleted,))
                state.setTimeoutTimestamp(max((deleted + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["path", "status", "at"])

    return events.withWatermark("ts", delay).groupBy("path").applyInPandasWithState(
        step, EXPIRY_OUTPUT, "deleted long", "append", GroupStateTimeout.EventTimeTimeout
    )


FAILURE_OUTPUT = "path string, reason string, retry_count int, ts timestamp, live boolean, version long"


def failure_memory(events: DataFrame, days: int = fv.RETENTION_DAYS, delay: str = "1 hour") -> DataFrame:
    """Failure records from failed, retried, succeeded and modified events (path, ts, event, reason).

    Success forgets a file, a modification resets its budget, and a record not
    renewed within the retention is dropped.
    """
    span = days * 86_400_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reason, retries, stamp, version = state.get if state.exists else (None, 0, None, 0)
        if state.hasTimedOut:
            reason, retries, stamp, version = None, 0, None, version + 1
        else:
            frame = pd.concat(list(batches)).sort_values(["ts", "seq"])
            for ts, event, why in zip(frame["ts"], frame["event"], frame["reason"]):
                at = _micros(ts)
                if stamp is not None and at - stamp >= span:
                    reason, retries, stamp = None, 0, None
                if event == "failed":
                    reason, stamp = why, at
                elif event == "retried" and stamp is not None:
                    retries += 1
                elif event == "modified" and stamp is not None:
                    retries = 0
                elif event == "succeeded":
                    reason, retries, stamp = None, 0, None
                version += 1
        state.update((reason, int(retries), stamp, int(version)))
        if stamp is not None:
            state.setTimeoutTimestamp(max((stamp + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"path": [key[0]], "reason": [reason], "retry_count": [int(retries)], "ts": [_stamp(stamp)],
             "live": [stamp is not None], "version": [int(version)]}
        )

    return events.withWatermark("ts", delay).groupBy("path").applyInPandasWithState(
        step, FAILURE_OUTPUT, "reason string, retries int, stamp long, version long", "update", GroupStateTimeout.EventTimeTimeout
    )

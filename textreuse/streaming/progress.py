"""Progress of tasks as state that ends: a row per update, heartbeats of quiet tasks, removal of finished ones."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISHED = ("completed", "failed", "cancelled")
OUT = "task_id string, event string, ts timestamp, status string, step long, total long, percent double, per_second double, seconds_left double, message string"
STATE = "started double, last double, status string, step long, total long, percent double, message string"


def track(events: DataFrame, late: str = "1 hour", keep_hours: float = 24, quiet_seconds: float | None = None) -> DataFrame:
    """One row (OUT) per task and micro-batch with its state after the batch; event is progress, heartbeat or removed.

    events: task_id, ts, status, step, total, percent, message; null leaves what is known, and a step of a known total
    sets the percent. The first event starts the clock; the rate is steps by time since then, seconds_left what the rest
    takes at it. A finished task leaves the state keep_hours of event time after its last event and says so once; an
    unfinished one that is silent for quiet_seconds of event time gives a heartbeat. Events behind the watermark are
    dropped, those before a task's last one change nothing.
    """

    def row(task: str, event: str, at: float, s: tuple) -> dict:
        started, last, status, step, total, percent, message = s
        rate = step / (last - started) if step and last > started else None
        left = (total - step) / rate if rate and total and step < total else None
        return {"task_id": task, "event": event, "ts": pd.Timestamp(at, unit="s"), "status": status, "step": step, "total": total, "percent": percent, "per_second": rate, "seconds_left": left, "message": message}

    def arm(state: GroupState, s: tuple) -> None:
        until = s[1] + keep_hours * 3600 if s[2] in FINISHED else s[1] + quiet_seconds if quiet_seconds else None
        if until is not None:
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))

    def step_of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s = tuple(state.get)
            at = state.getCurrentWatermarkMs() / 1000
            if s[2] in FINISHED:
                state.remove()
                yield frame([row(key[0], "removed", at, s)])
            else:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + max(1, int(quiet_seconds * 1000)))
                yield frame([row(key[0], "heartbeat", at, s)])
            return
        s = tuple(state.get) if state.exists else None
        events = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for e in events.to_dict("records"):
            at = e["ts"].timestamp() if e["ts"].tzinfo else e["ts"].replace(tzinfo=timezone.utc).timestamp()
            if s is not None and at < s[1]:
                continue
            known = lambda c: None if pd.isna(e[c]) else e[c]  # noqa: E731, B023
            old = s or (at, at, "pending", None, None, None, None)
            number = lambda c, k: int(e[c]) if known(c) is not None else old[k]  # noqa: E731, B023
            step, total = number("step", 3), number("total", 4)
            percent = float(known("percent")) if known("percent") is not None else 100 * step / total if step is not None and total else old[5]
            s = (old[0], at, known("status") or old[2], step, total, percent, known("message") or old[6])
        state.update(s)
        arm(state, s)
        yield frame([row(key[0], "progress", s[1], s)])

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows).astype({"step": "Int64", "total": "Int64", "percent": float, "per_second": float, "seconds_left": float})

    need = {"task_id": "string", "ts": "timestamp", "status": "string", "step": "long", "total": "long", "percent": "double", "message": "string"}
    shaped = events.select(*((F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in need.items()))
    shaped = shaped.where("task_id is not null and ts is not null").withWatermark("ts", late)
    return shaped.groupBy("task_id").applyInPandasWithState(step_of, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)

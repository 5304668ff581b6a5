"""Live traffic control: token bucket and circuit breaker as keyed streaming state.

The state machines are those of the batch replay, so a stream gives what a replay of its log gives. State is a few
numbers per source and expires when a source has been silent for ``idle``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.traffic import Breaker, Bucket

IDLE_MS = 3_600_000


def admit_stream(requests: DataFrame, per_second: float, at_once: int, per_minute: int | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """requests: source string, ts timestamp -> source, ts_ms, admitted, wait_ms per request, in time order within a batch."""
    capacity = max(1.0, min(per_second, float(at_once)))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = Bucket(max(per_second, 0.001), capacity, per_minute)
        if state.exists:
            tokens, last, cool, minute = state.get
            b.tokens, b.last, b.cooldown_until, b.minute = tokens, last, cool, deque(minute)
        rows = pd.concat(list(frames)).sort_values("ts_ms")
        out = []
        for now in rows["ts_ms"]:
            wait = b.wait_ms(now)
            out.append((key[0], float(now), b.take(now), round(wait, 3)))
        state.update((b.tokens, b.last, b.cooldown_until, list(b.minute)))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source", "ts_ms", "admitted", "wait_ms"])

    keyed = requests.select("source", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ts_ms"))
    return keyed.groupBy("source").applyInPandasWithState(
        step, "source string, ts_ms double, admitted boolean, wait_ms double", "tokens double, last double, cool double, minute array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def breaker_stream(outcomes: DataFrame, threshold: int = 5, cooldown_ms: float = 30_000, needed: int = 2, idle_ms: int = IDLE_MS) -> DataFrame:
    """outcomes: source string, ts timestamp, failed boolean -> source, ts_ms, allowed, state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = Breaker(threshold, cooldown_ms, needed)
        if state.exists:
            b.state, b.failures, opened, b.probes, b.trips = state.get
            b.opened = None if opened < 0 else opened
        rows = pd.concat(list(frames)).sort_values("ts_ms")
        out = []
        for now, failed in zip(rows["ts_ms"], rows["failed"]):
            ok = b.admit(now)
            if ok:
                b.record(not failed, now)
            out.append((key[0], float(now), ok, b.state))
        state.update((b.state, b.failures, -1.0 if b.opened is None else b.opened, b.probes, b.trips))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source", "ts_ms", "allowed", "state"])

    keyed = outcomes.select("source", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ts_ms"), "failed")
    return keyed.groupBy("source").applyInPandasWithState(
        step, "source string, ts_ms double, allowed boolean, state string", "state string, failures int, opened double, probes int, trips int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def status_windows(log: DataFrame, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Requests per source, status and minute, late entries up to the watermark included. log: source, ts, status, duration_ms."""
    return (
        log.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width).alias("w"), "source", "status")
        .agg(F.count("*").alias("requests"), F.sum("duration_ms").alias("duration_ms"))
        .select(F.col("w.start").alias("start"), "source", "status", "requests", "duration_ms")
    )

"""Per-source traffic control replayed over a request log.

Sliding counts and failure runs are window expressions. Token bucket, breaker and cache carry recursive state, so each
source's requests are folded in time order: partitioned by source, sorted within, streamed batch by batch, and the state that
is kept is constant (bucket, breaker) or bounded by its settings (minute window, cache).
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def minute_counts(log: DataFrame, by: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Requests of the last minute, the present one included."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(us).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return log.withColumn("in_minute", F.count("*").over(w))


def failure_runs(log: DataFrame, by: str, failed: str, order: list[str]) -> DataFrame:
    """Length of the run of failures that a request closes; 0 for a success."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = log.withColumn("island", island)
    run = F.sum(F.col(failed).cast("bigint")).over(Window.partitionBy(by, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("run", run).drop("island")


@dataclass
class Bucket:
    """Token bucket with a minute ceiling and cooldowns; times in ms."""

    per_second: float
    capacity: float
    per_minute: int | None = None
    tokens: float = -1.0
    last: float | None = None
    cooldown_until: float = 0.0
    minute: deque = field(default_factory=deque)

    def refill(self, now: float) -> None:
        if self.last is None:
            self.tokens, self.last = self.capacity, now
        elif now > self.last:
            self.tokens = min(self.capacity, self.tokens + (now - self.last) / 1000 * self.per_second)
            self.last = now

    def wait_ms(self, now: float) -> float:
        """How long a request would have to wait."""
        self.refill(now)
        token = max(0.0, 1 - self.tokens) / self.per_second * 1000
        ceiling = max(0.0, self.minute[-self.per_minute] + 60_000 - now) if self.per_minute and len(self.minute) >= self.per_minute else 0.0
        return max(max(0.0, self.cooldown_until - now), token, ceiling)

    def take(self, now: float) -> bool:
        self.refill(now)
        while self.minute and self.minute[0] <= now - 60_000:
            self.minute.popleft()
        if self.cooldown_until > now or self.tokens < 1 or (self.per_minute and len(self.minute) >= self.per_minute):
            return False
        self.tokens -= 1
        if self.per_minute:
            self.minute.append(now)
        return True

    def cool(self, now: float, ms: float) -> None:
        if ms > 0:
            self.cooldown_until = max(self.cooldown_until, now + ms)
            self.tokens = 0.0


@dataclass
class Breaker:
    """CLOSED, OPEN after repeated failures, HALF_OPEN after the cooldown; times in ms."""

    threshold: int = 5
    cooldown_ms: float = 30_000
    needed: int = 2
    state: str = "CLOSED"
    failures: int = 0
    opened: float | None = None
    probes: int = 0
    trips: int = 0

    def admit(self, now: float) -> bool:
        if self.state == "OPEN" and self.opened is not None and now >= self.opened + self.cooldown_ms:
            self.state, self.probes = "HALF_OPEN", 0
        return self.state != "OPEN"

    def record(self, ok: bool, now: float) -> None:
        if self.state == "HALF_OPEN":
            if not ok:
                self._trip(now)
            else:
                self.probes += 1
                if self.probes >= self.needed:
                    self.state, self.failures, self.probes, self.opened = "CLOSED", 0, 0, None
        elif ok:
            self.failures = 0
        else:
            self.failures += 1
            if self.failures >= self.threshold:
                self._trip(now)

    def _trip(self, now: float) -> None:
        self.state, self.opened, self.probes, self.trips = "OPEN", now, 0, self.trips + 1


class TtlLru:
    """Bounded cache: a hit renews recency but not the time to live; expired entries go before the oldest."""

    def __init__(self, ttl_ms: float, most: int):
        self.ttl_ms, self.most = ttl_ms, most
        self.store: OrderedDict[str, float] = OrderedDict()
        self.evictions = 0

    def get(self, key: str, now: float) -> bool:
        until = self.store.get(key)
        if until is None:
            return False
        if until <= now:
            del self.store[key]
            return False
        self.store.move_to_end(key)
        return True

    def put(self, key: str, now: float, ttl_ms: float | None = None) -> None:
        ttl = self.ttl_ms if ttl_ms is None else ttl_ms
        if ttl <= 0:
            return
        self.store.pop(key, None)
        self.store[key] = now + ttl
        if len(self.store) > self.most:
            for k in [k for k, u in self.store.items() if u <= now]:
                del self.store[k]
            while len(self.store) > self.most:
                self.store.popitem(last=False)
                self.evictions += 1


def _replay(log: DataFrame, by: str, order: list[str], columns: str, start, step) -> DataFrame:
    """Folds each group in order; ``step(state, row) -> tuple`` of the added columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema) + ", " + columns
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    # one partition per group key range, sorted within, so a group arrives in order and in batches
    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, object()
        for b in batches:
            keys = b.column(by).to_pylist()
            rows = []
            for k, r in zip(keys, b.to_pylist()):
                if k != current:
                    state, current = start(), k
                rows.append(step(state, r))
            added = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    return log.repartition(by).sortWithinPartitions(by, *order).mapInArrow(by_group, schema)


def token_bucket(log: DataFrame, by: str, order: list[str], per_second: float, at_once: int, per_minute: int | None = None, cooldown_ms: str | None = None) -> DataFrame:
    """Adds admitted, wait_ms and tokens. log: ts_ms double; ``cooldown_ms`` names a column with provider cooldowns."""

    def step(b: Bucket, r: dict) -> tuple:
        now = r["ts_ms"]
        wait = b.wait_ms(now)
        ok = b.take(now)
        if cooldown_ms and r[cooldown_ms]:
            b.cool(now, r[cooldown_ms])
        return ok, round(wait, 3), round(b.tokens, 4)

    return _replay(log, by, order, "admitted boolean, wait_ms double, tokens double", lambda: Bucket(max(per_second, 0.001), max(1.0, min(per_second, float(at_once))), per_minute), step)


def circuit_breaker(log: DataFrame, by: str, order: list[str], failed: str, threshold: int = 5, cooldown_ms: float = 30_000, needed: int = 2) -> DataFrame:
    """Adds allowed, state (after the request) and trips. A refused request leaves no outcome."""

    def step(b: Breaker, r: dict) -> tuple:
        ok = b.admit(r["ts_ms"])
        if ok:
            b.record(not r[failed], r["ts_ms"])
        return ok, b.state, b.trips

    return _replay(log, by, order, "allowed boolean, state string, trips int", lambda: Breaker(threshold, cooldown_ms, needed), step)


def cache_replay(log: DataFrame, by: str, order: list[str], key: str, ttl_ms: float, most: int) -> DataFrame:
    """Adds hit, entries and evictions of a read-through cache."""

    def step(c: TtlLru, r: dict) -> tuple:
        k = r[key]
        hit = c.get(k, r["ts_ms"])
        if not hit:
            c.put(k, r["ts_ms"])
        return hit, len(c.store), c.evictions

    return _replay(log, by, order, "hit boolean, entries int, evictions int", lambda: TtlLru(ttl_ms, most), step)

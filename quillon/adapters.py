"""What stands between a source and its readers: drift repair, breaker, concurrency, retry, renaming."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.config import RetrySettings
from quillon.errors import Code, make


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _warn(code: Code, text: str) -> str:
    return f"[{code.label}] {text}"


@dataclass
class Drift:
    """A repaired frame; what a cast lost is known once a frame over it has run."""

    df: DataFrame
    known: list[str]
    unsure: dict[str, tuple[str, str]] = field(default_factory=dict)
    seen: str | None = None

    def warnings(self, ran: DataFrame | None = None) -> list[str]:
        """Warnings, with the casts' outcome if ``ran`` is the frame over this one that an action has run on."""
        out = list(self.known)
        counts = None
        if self.seen and ran is not None:
            found = ran._jdf.queryExecution().observedMetrics().get(self.seen)
            if found.isDefined():
                counts = {f"lost_{i}": found.get().get(i) for i in range(len(self.unsure))}
        for i, (name, (was, now)) in enumerate(self.unsure.items()):
            if counts is None:
                out.append(_warn(Code.DRIFT_TYPE_CHANGED, f"Column '{name}' type coerced from {was} to {now} (unverified)"))
            elif counts[f"lost_{i}"]:
                out.append(_warn(Code.DRIFT_TYPE_CHANGED, f"Column '{name}' cast failed from {was} to {now}, NULL-filled"))
            else:
                out.append(_warn(Code.DRIFT_TYPE_CHANGED, f"Column '{name}' type coerced from {was} to {now}"))
        return out


def castable(df: DataFrame, column: Column, kind: T.DataType) -> bool:
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(df.select(column).schema[0].dataType, nested) != isinstance(kind, nested) and not isinstance(kind, T.StringType):
        return False
    try:
        return bool(df.select(column.try_cast(kind)).schema)
    except AnalysisException:
        return False


def reconcile(df: DataFrame, expected: T.StructType, observe: bool = True) -> Drift:
    """``df`` in the expected schema: names match by case, order is the expected one.

    A missing column is NULL, another type is cast where that is possible (bad values become NULL),
    an incompatible one is all NULL, an extra column goes. Columns that did not drift are plain
    references, so filters and pruning still reach the source. Losses are counted on the way by an
    observation, never by a job of their own.
    """
    actual = {f.name: f for f in df.schema.fields}
    out, known, unsure, losses = [], [], {}, []
    for name, f in actual.items():
        if name not in expected.fieldNames():
            known.append(_warn(Code.DRIFT_EXTRA_COLUMN, f"Extra column '{name}' of type {f.dataType.simpleString()} dropped"))
    inner = [f"c{i}" for i in range(len(df.columns))]
    place = {f.name: c for f, c in zip(df.schema.fields, inner, strict=True)}
    rows = df.toDF(*inner)
    for f in expected.fields:
        want = f.dataType.simpleString()
        if f.name not in actual:
            known.append(_warn(Code.DRIFT_MISSING_COLUMN, f"Missing column '{f.name}' (expected {want}), NULL-filled"))
            out.append(F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata))
            continue
        source, was = F.col(place[f.name]), actual[f.name].dataType
        if was == f.dataType:
            out.append(source.alias(f.name, metadata=f.metadata))
        elif castable(rows, source, f.dataType):
            made = source.try_cast(f.dataType)
            losses.append(F.count(F.when(source.isNotNull() & made.isNull(), 1)).alias(f"lost_{len(unsure)}"))
            unsure[f.name] = (was.simpleString(), want)
            out.append(made.alias(f.name, metadata=f.metadata))
        else:
            known.append(_warn(Code.DRIFT_TYPE_CHANGED, f"Column '{f.name}' cast failed from {was.simpleString()} to {want}, NULL-filled"))
            out.append(F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata))
    seen = None
    if losses and observe:
        seen = f"drift-{uuid.uuid4().hex}"
        rows = rows.observe(seen, *losses)
    return Drift(rows.select(*out), known, unsure, seen)


_WIDER = {("int", "bigint"), ("float", "double"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint")}


def adapt(df: DataFrame, logical: T.StructType) -> DataFrame:
    """Physical columns renamed to logical ones: by name, else by a ``_name`` ending, else by position if that name is equal but for case.

    Types must be equal or widen without loss.
    """
    out = []
    for i, f in enumerate(logical.fields):
        names = df.columns
        found = f.name if f.name in names else next((n for n in names if n.endswith("_" + f.name)), None)
        if found is None and i < len(names) and names[i].lower() == f.name.lower():
            found = names[i]
        if found is None:
            raise make(Code.FIELD_NOT_FOUND, f"no column for '{f.name}'", columns=names)
        was, want = df.schema[found].dataType.simpleString(), f.dataType.simpleString()
        if was != want and (was, want) not in _WIDER:
            raise make(Code.TYPE_MISMATCH, f"column '{found}' is {was}, '{f.name}' is {want}")
        out.append(F.col(quoted(found)).cast(f.dataType).alias(f.name))
    return df.select(*out)


class CircuitBreaker:
    """Opens when at least 5 attempts within 300 s fail at a rate of 1/2; half-open after 30 s; closes after 2 successes."""

    def __init__(self, name: str, attempts: int = 5, rate: float = 0.5, window: float = 300, reset: float = 30, successes: int = 2, clock: Callable[[], float] = time.monotonic):
        self.name, self.attempts, self.rate, self.window, self.reset, self.successes, self.clock = name, attempts, rate, window, reset, successes, clock
        self.state, self._since, self._good = "closed", 0.0, 0
        self._seen: deque[tuple[float, bool]] = deque()
        self._lock = threading.Lock()

    def allow(self) -> bool:
        with self._lock:
            if self.state == "open" and self.clock() - self._since >= self.reset:
                self.state, self._good = "half-open", 0
            return self.state != "open"

    def record(self, ok: bool) -> None:
        with self._lock:
            now = self.clock()
            if self.state == "half-open":
                if not ok:
                    self.state, self._since = "open", now
                    return
                self._good += 1
                if self._good >= self.successes:
                    self.state = "closed"
                    self._seen.clear()
                return
            self._seen.append((now, ok))
            while self._seen and now - self._seen[0][0] > self.window:
                self._seen.popleft()
            failed = sum(not x for _, x in self._seen)
            if not ok and len(self._seen) >= self.attempts and failed / len(self._seen) >= self.rate:
                self.state, self._since = "open", now

    def call(self, f: Callable, *args):
        if not self.allow():
            raise make(Code.DATABASE_ERROR, f"Circuit breaker is OPEN for source '{self.name}'")
        try:
            out = f(*args)
        except Exception:
            self.record(False)
            raise
        self.record(True)
        return out


class Slots:
    """At most ``n`` at a time, 0 for no limit; waits up to ``wait`` seconds."""

    def __init__(self, n: int, wait: float | None = None):
        self._gate = threading.BoundedSemaphore(n) if n else None
        self.wait = wait

    def __enter__(self):
        if self._gate and not self._gate.acquire(timeout=self.wait):
            raise make(Code.SLOT_UNAVAILABLE, f"no slot within {self.wait} s")
        return self

    def __exit__(self, *_):
        if self._gate:
            self._gate.release()


def retry_delay_ms(attempt: int, settings: RetrySettings, jitter: Callable[[], float] = random.random) -> int:
    """base * 2^attempt plus up to a second of jitter, capped."""
    return int(min(settings.base_delay_ms * 2**attempt + jitter() * 1000, settings.max_delay_ms))


def with_retry(f: Callable, settings: RetrySettings, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(1, max(1, settings.max_attempts) + 1):
        try:
            return f()
        except Exception:
            if attempt >= settings.max_attempts:
                raise
            sleep(retry_delay_ms(attempt, settings) / 1000)
    raise AssertionError


class TtlCache:
    """Entries that expire after ``ttl`` seconds, the oldest going first beyond ``most`` of them."""

    def __init__(self, ttl: float = 300, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock, self._held = ttl, most, clock, {}

    def get(self, key, make_value: Callable):
        at, value = self._held.get(key, (None, None))
        if at is None or self.clock() - at >= self.ttl:
            value = make_value()
            self._held.pop(key, None)
            self._held[key] = (self.clock(), value)
            while len(self._held) > self.most:
                self._held.pop(next(iter(self._held)))
        return value

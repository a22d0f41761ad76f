"""Caches with a size and a time to live, as their hits and misses would have been.

An entry lives for a fixed time from its write; a hit doesn't renew that, but makes the entry the last to be evicted. A miss writes its key; where
the cache is then over its size, expired entries go first, then the entry that was used longest ago. A cache is one sequence of
look-ups; `stripes` splits a large one by key into caches of an equal share of the size, which run on their own, as a concurrent cache does.
"""

from __future__ import annotations

import bisect
import pickle
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import ship

#: Fixed value: the state store that states with timers and maps need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entries:
    """The keys of a cache with the times until which they live, the one that was used longest ago first."""

    def __init__(self, size: int, micros: int, until: list[tuple[Any, int]] = ()) -> None:
        self.size, self.micros, self.until = size, micros, OrderedDict(until)

    def look_up(self, key: Any, at: int) -> bool:
        hit = self.until.get(key, at) > at
        if hit:
            self.until.move_to_end(key)
            return True
        self.until.pop(key, None)
        self.until[key] = at + self.micros
        if len(self.until) > self.size:
            gone = [k for k, t in self.until.items() if t <= at] or [next(iter(self.until))]
            for k in gone:
                del self.until[k]
        return False


def _placed(events: DataFrame, cache: str, key: str, time: str, tie: str, stripes: int) -> DataFrame:
    """cache, stripe, key, at, tie of look-ups; those without a key or time are none."""
    text = lambda c: F.col(c).cast("string")
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    return rows.select(F.coalesce(text(cache), F.lit("")).alias("cache"), F.pmod(F.xxhash64(text(key)), F.lit(stripes)).cast("int").alias("stripe"), text(key).alias("key"), F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).cast("bigint").alias("tie"))


RESULT = "cache string, stripe int, key string, at bigint, tie bigint, hit boolean"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: Microseconds of a span of look-ups that wait together, look-ups that a task holds before they wait, and answers that it gives at a time.
SPAN, HELD, ANSWERS = 3_600_000_000, 100_000, 10_000


def hits(events: DataFrame, cache: str, key: str, time: str, seconds: int, size: int, tie: str = "event_id", stripes: int = 1) -> DataFrame:
    """RESULT for each look-up of a table, by time and then tie. A stripe's look-ups come sorted to one task, a batch at a time; it
    holds the entries only."""
    ship(events.sparkSession)
    ordered = _placed(events, cache, key, time, tie, stripes).drop(time).repartition("cache", "stripe").sortWithinPartitions("cache", "stripe", "at", "tie", "key")
    share = max(1, -(-size // stripes))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, entries = None, None
        for f in frames:
            out = []
            for name, stripe, k, at in f[["cache", "stripe", "key", "at"]].itertuples(index=False, name=None):
                if (name, stripe) != last:
                    last, entries = (name, stripe), Entries(share, seconds * 1_000_000)
                out.append(entries.look_up(k, at))
            yield f.assign(hit=out)

    return ordered.mapInPandas(each, RESULT)


class BoundedCache(StatefulProcessor):
    """Look-ups wait in the state, by time, until the watermark has passed them, so that micro-batches may bring them in any order; a timer
    then runs those that are due through the cache. State: what waits, in chunks by span of time, and `size` entries at most. A task holds HELD
    look-ups that come, and those of one span that are due."""

    def __init__(self, size: int, micros: int) -> None:
        self.size, self.micros = size, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "spans binary")
        self.chunks = handle.getMapState("chunks", "span bigint, no int", "rows binary")
        self.entries = handle.getListState("entries", "key string, until bigint")
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, at: int) -> None:
        """The timer at the first look-up that waits."""
        ms = at // 1000 + 1
        now = self.timer.get()
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _spans(self) -> dict[int, tuple[int, int]]:
        """The spans in which look-ups wait: the number of chunks, and the first look-up."""
        return pickle.loads(bytes(self.spans.get()[0])) if self.spans.exists() else {}

    def _wait(self, f: pd.DataFrame, spans: dict[int, tuple[int, int]]) -> None:
        """Adds a chunk to each span of f(at, tie, key)."""
        for span, rows in f.groupby(f["at"] // SPAN, sort=False):
            span, first = int(span), int(rows["at"].min())
            chunks, before = spans.get(span, (0, first))
            self.chunks.updateValue((span, chunks), (pickle.dumps([rows[c].tolist() for c in ("at", "tie", "key")]),))
            spans[span] = (chunks + 1, min(before, first))

    def _taken(self, span: int, chunks: int) -> list[tuple]:
        """The look-ups (at, tie, key) of a span, in order, which leave the state."""
        rows = []
        for no in range(chunks):
            rows += zip(*pickle.loads(bytes(self.chunks.getValue((span, no))[0])), strict=True)
            self.chunks.removeKey((span, no))
        return sorted(rows)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spans, held, n = self._spans(), [], 0
        for f in rows:
            if len(f):
                held.append(f[["at", "tie", "key"]])
                n += len(f)
            if n >= HELD:
                self._wait(pd.concat(held), spans)
                held, n = [], 0
        if held:
            self._wait(pd.concat(held), spans)
        if spans:
            self.spans.update((pickle.dumps(spans),))
            self._wake(min(first for _, first in spans.values()))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans, out = self._spans(), []
        cache = Entries(self.size, self.micros, [tuple(e) for e in self.entries.get()] if self.entries.exists() else [])
        for span in sorted(s for s, (_, first) in spans.items() if first < now):
            places = self._taken(span, spans.pop(span)[0])
            due = bisect.bisect_left(places, now, key=lambda p: p[0])
            out += [(key[0], key[1], k, at, tie, cache.look_up(k, at)) for at, tie, k in places[:due]]
            if due < len(places):
                self._wait(pd.DataFrame(places[due:], columns=["at", "tie", "key"]), spans)
            if len(out) >= ANSWERS:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if cache.until:
            self.entries.put([*cache.until.items()])
        self.timer.clear()
        if spans:
            self.spans.update((pickle.dumps(spans),))
            self._wake(min(first for _, first in spans.values()))
        else:
            self.spans.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_ready(spark: SparkSession) -> None:
    """The session's state store for queries that are started from now on. A caller that needs another one sets it again."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def stream_hits(events: DataFrame, cache: str, key: str, time: str, seconds: int, size: int, tie: str = "event_id", stripes: int = 1) -> DataFrame:
    """hits() of a stream with a watermark on `time`: a look-up is answered, once, when the watermark has passed it. Rows that come behind the
    watermark are late and are not answered."""
    stream_ready(events.sparkSession)
    share = max(1, -(-size // stripes))
    placed = _placed(events, cache, key, time, tie, stripes)
    return placed.groupBy("cache", "stripe").transformWithStateInPandas(statefulProcessor=BoundedCache(share, seconds * 1_000_000), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")

"""Counters, cumulative histograms, rate limits, sessions and expiring caches over event tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """labels, le, n, total, count: how many values are at most each bound, their sum and number. One pass, no join."""
    v = F.col(value)
    sums = [F.count(F.when(v <= b, 1)).alias(f"_{i}") for i, b in enumerate(bounds)]
    rows = events.groupBy(*labels).agg(*sums, F.round(F.coalesce(F.sum(v), F.lit(0.0)), 4).alias("total"), F.count(v).alias("count"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return rows.select(*labels, "total", "count", F.inline(pairs))


def rate_limited(requests: DataFrame, client: str, time: str, limit: int, grain: str = "minute", tie: str = "event_id") -> DataFrame:
    """`requests` with allowed: whether each is among the first `limit` of its client's minute (or other grain)."""
    place = F.row_number().over(Window.partitionBy(client, F.date_trunc(grain, time)).orderBy(time, tie))
    return requests.withColumn("allowed", place <= limit)


def sessions(events: DataFrame, client: str, time: str, gap: str = "24 hours") -> DataFrame:
    """client, session_start, session_end, n: spans in which each event refreshes the time to live; a gap as long as that ends one."""
    rows = events.groupBy(client, F.session_window(F.col(time).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(client, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def prompt_cache(calls: DataFrame, keys: list[str], read: str, written: str) -> DataFrame:
    """keys, calls, hits, tokens_read, tokens_written: a call hits if it reads any tokens."""
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0))
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count(F.when(tokens(read) > 0, 1)).alias("hits"), F.sum(tokens(read)).alias("tokens_read"), F.sum(tokens(written)).alias("tokens_written"))


def readiness(checks: DataFrame, service: str, status: Column) -> DataFrame:
    return checks.groupBy(service).agg(F.bool_and(status.isin("ok", "skipped")).alias("ready"))


def alive(rows: DataFrame, written: str, ttl_seconds: int, now: Column) -> DataFrame:
    """What a store keeps: rows written within the time to live before `now`."""
    return rows.where(F.col(written) >= now - F.make_interval(secs=F.lit(ttl_seconds)))


def latest_alive(rows: DataFrame, key: str, written: str, ttl_seconds: int, now: Column, tie: str) -> DataFrame:
    """The last row of each key, if it is within its time to live."""
    last = Window.partitionBy(key).orderBy(F.col(written).desc(), F.col(tie).desc())
    return alive(rows, written, ttl_seconds, now).withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def first_seen(calls: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key, names: the different names of each key in the order in which they first came, summed up before they are shuffled."""
    firsts = calls.groupBy(key, name).agg(F.min(order).alias("_at"))
    rows = F.array_sort(F.collect_list(F.struct("_at", name)))
    return firsts.groupBy(key).agg(F.transform(rows, lambda r: r[name]).alias("names"))


def ttl_hits(events: DataFrame, key: str, time: str, seconds: int, tie: str = "event_id") -> DataFrame:
    """key, time, tie, hit: whether a look-up finds the entry that the last miss of its key wrote. A hit doesn't renew it.

    A key's look-ups come sorted, in batches, to one task, which keeps one number of state; they are never in memory together.
    """
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).alias("tie"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "tie")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: Any = None
        until = 0
        for f in frames:
            hits = []
            for k, at in zip(f["key"].tolist(), f["at"].tolist(), strict=True):
                hit = k == last and at < until
                if not hit:
                    last, until = k, at + seconds * 1_000_000
                hits.append(hit)
            yield f.assign(hit=hits)

    kind = dict(rows.dtypes)
    return ordered.mapInPandas(each, f"key {kind['key']}, at bigint, tie {kind['tie']}, hit boolean").select(F.col("key").alias(key), F.timestamp_micros("at").alias(time), F.col("tie").alias(tie), "hit")

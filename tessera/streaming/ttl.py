"""Expiring caches over a stream: an entry lives for a fixed time from its write, and a hit doesn't renew it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ttl_hits(events: DataFrame, key: str, time: str, seconds: int, tie: str = "event_id") -> DataFrame:
    """key, time, tie, hit for each look-up of a stream, by event time; state is one number a key and leaves when it expires
    behind the watermark."""

    def each(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else 0
        f = pd.concat([*frames]).sort_values(["at", "tie"])
        hits = []
        for at in f["at"].tolist():
            hit = at < until
            until = until if hit else at + seconds * 1_000_000
            hits.append(hit)
        state.update((until,))
        if until // 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until // 1000)
        yield pd.DataFrame({"key": k[0], "at": f["at"], "tie": f["tie"], "hit": hits})

    rows = events.select(F.col(key).alias("key"), F.col(time), F.unix_micros(F.col(time)).alias("at"), F.col(tie).cast("bigint").alias("tie"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(each, f"key {kind}, at bigint, tie bigint, hit boolean", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)

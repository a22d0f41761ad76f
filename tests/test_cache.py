"""Bounded caches, in batch and over shuffled micro-batches, against one that is written plainly."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.streaming import cache

SF = "/root/testdata/sf0.001"


def plain(rows, seconds, size):
    """{tie: hit} of (cache, key, at in seconds, tie)."""
    entries, out = {}, {}
    for name, key, at, tie in sorted(rows, key=lambda r: (r[2], r[3])):
        mine = entries.setdefault(name, [])  # [key, until], the last used at the end
        found = next((e for e in mine if e[0] == key), None)
        out[tie] = found is not None and found[1] > at
        if found is not None:
            mine.remove(found)
        mine.append(found if out[tie] else [key, at + seconds])
        if len(mine) > size:
            live = [e for e in mine if e[1] > at]
            entries[name] = live if len(live) < len(mine) else mine[1:]
    return out


def lookups(n=600):
    r = random.Random(2)
    return [(r.choice("ab"), r.choice("pqrstuvw"), r.randint(0, 2000), i) for i in range(n)]


def test_batch_equals_a_plain_cache(spark):
    rows = lookups()
    df = spark.createDataFrame([(*x, "clash") for x in rows], "cache string, key string, at int, event_id int, hit string").withColumn("ts", F.timestamp_seconds("at"))
    for seconds, size in ((60, 3), (10, 1), (10_000, 5)):
        got = {r["tie"]: r["hit"] for r in cache.hits(df, "cache", "key", "ts", seconds, size).collect()}
        assert got == plain(rows, seconds, size) and 0 < sum(got.values()) < len(got)
    striped = cache.hits(df, "cache", "key", "ts", 60, 4, stripes=2).collect()
    assert len(striped) == len(rows) and {r["stripe"] for r in striped} == {0, 1}
    nulls = df.select(F.lit(None).cast("string").alias("cache"), F.when(F.col("event_id") > 5, F.col("key")).alias("key"), "ts", "event_id")
    assert cache.hits(nulls, "cache", "key", "ts", 60, 3).count() == len(rows) - 6
    assert cache.hits(df.limit(0), "cache", "key", "ts", 60, 3).count() == 0


def test_stream_over_shuffled_batches_equals_a_plain_cache(spark, tmp_path):
    """Five files, out of order within 300 seconds, and one far ahead that brings the watermark past all others."""
    rows = sorted(lookups(300), key=lambda r: r[2])
    r = random.Random(9)
    delayed = sorted(rows, key=lambda x: x[2] + r.uniform(0, 250))
    for i in range(5):
        part = delayed[i * 60 : (i + 1) * 60]
        r.shuffle(part)
        df = spark.createDataFrame(part, "cache string, key string, at int, event_id int").withColumn("ts", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    spark.createDataFrame([("z", "z", 9000, -1)], "cache string, key string, at int, event_id int").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema("cache string, key string, at int, event_id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "300 seconds")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        out = cache.stream_hits(stream, "cache", "key", "ts", 60, 3)
        query = out.writeStream.outputMode("append").format("memory").queryName("bounded").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        got = {x["tie"]: x["hit"] for x in spark.table("bounded").collect() if x["tie"] >= 0}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == plain(rows, 60, 3)


def test_a_timer_holds_a_span_at_a_time():
    """What waits is read and answered a span at a time, in order, and what isn't due waits on."""
    import pandas as pd

    class State(dict):
        def __init__(self):
            self.value, self.most = None, 0

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def exists(self):
            return self.value is not None

        def clear(self):
            self.value = None

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]

        def updateValue(self, key, value):
            self[key] = value

        getValue, removeKey = dict.get, dict.__delitem__

    class Handle:
        getMapState = getValueState = getListState = lambda self, *_: State()
        registerTimer = deleteTimer = lambda self, _: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 99 * 3_600_000 + 1_800_000

    p = cache.BoundedCache(5, 7_200_000_000)
    p.init(Handle())
    r = random.Random(4)
    rows = [("a", r.choice("pqrstuvw"), r.randint(0, 100 * 3600 - 1), i) for i in range(60_000)]
    frame = pd.DataFrame([(at * 1_000_000, tie, key) for _, key, at, tie in rows], columns=["at", "tie", "key"])
    for part in (frame[:30_000], frame[30_000:]):
        assert not list(p.handleInputRows(("a", 0), iter([part]), None))
    got = list(p.handleExpiredTimer(("a", 0), Times(), None))
    due = [x for x in rows if x[2] < 99 * 3600 + 1800]
    assert len(got) > 4 and max(map(len, got)) < 12_000
    assert {t: h for f in got for t, h in zip(f["tie"], f["hit"], strict=True)} == plain(due, 7200, 5)
    Times.getCurrentWatermarkInMs = lambda self: 200 * 3_600_000
    rest = list(p.handleExpiredTimer(("a", 0), Times(), None))
    assert sum(map(len, rest)) == len(rows) - len(due) > 0 and not p.chunks and not p.spans.exists()


def test_queries_over_the_events(spark):
    events = catalogue.table(spark, SF, "events").select("event_type", F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")), "event_id").collect()
    want = plain([tuple(x) for x in events], 86_400 * 1_000_000, 50)
    assert {r["tie"]: r["hit"] for r in catalogue.bounded_cache_hits(spark, SF).collect()} == want
    got = {r["tie"]: r["hit"] for r in catalogue.stream_bounded_cache(spark, SF).collect()}
    last = max(x[2] for x in events)
    assert got.items() <= want.items() and {x[3] for x in events if x[2] < last - 700 * 1_000_000} <= got.keys()

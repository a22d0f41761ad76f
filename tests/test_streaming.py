"""Streams against batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.session import table
from tessera.streaming import ingest, ttl, windows

SF = "/root/testdata/sf0.001"


def events(spark):
    return spark.readStream.schema(table(spark, SF, "events").schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def run(stream, folder, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_expiring_cache(spark, tmp_path):
    rows = run(ttl.ttl_hits(windows.watermarked(events(spark)), "user_id", "ts", 86_400), tmp_path, "hits")
    want = metrics.ttl_hits(table(spark, SF, "events"), "user_id", "ts", 86_400)
    assert {r["tie"]: r["hit"] for r in rows.collect()} == {r["event_id"]: r["hit"] for r in want.collect()}


def test_windows_in_complete_mode_equal_the_batch(spark, tmp_path):
    shape = lambda e: windows.counted(e, ["event_type"], windows.tumbling("ts", "1 hour"), "value")
    rows = run(shape(windows.watermarked(events(spark))), tmp_path, "hourly", "complete")
    batch = shape(table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda r: (r["event_type"], r["window_start"], r["n"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, batch.collect()))


def test_ingestion_of_versions_failures_and_empty_files(spark, tmp_path):
    each = ingest.index_batches(f"{tmp_path}/index", f"{tmp_path}/ledger", lambda rows: rows)
    schema = "key string, version string, text string, error string"
    first = spark.createDataFrame([("a", "1", "some text here", None), ("b", "1", "more text here", None), ("c", "1", " ", None), ("d", "1", None, "broken")], schema)
    each(first, 0)
    each(first, 0)  # a batch that is run again
    each(spark.createDataFrame([("a", "1", "some text here", None), ("a", "2", "other text now", None), ("d", "1", "now it works", None)], schema), 1)
    got = sorted((r["source"], r["version"], r["chunk"]) for r in ingest.latest(spark, f"{tmp_path}/index").collect())
    assert got == [("a", "2", "other text now"), ("b", "1", "more text here"), ("d", "1", "now it works")]
    ledger = ingest.stored(spark, f"{tmp_path}/ledger", ingest.LEDGER)
    assert sorted((r["key"], r["version"], r["status"]) for r in ledger.collect()) == [("a", "1", "indexed"), ("a", "2", "indexed"), ("b", "1", "indexed"), ("c", "1", "empty"), ("d", "1", "indexed")]


def test_files_come_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"file {i}")
    rows = run(ingest.file_stream(spark, str(tmp_path / "in"), 1).select("path", F.decode("content", "UTF-8").alias("text")), tmp_path, "files")
    assert sorted(r["text"] for r in rows.collect()) == ["file 0", "file 1", "file 2"]

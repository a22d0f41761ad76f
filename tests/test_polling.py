"""Polled folders: versions once, oldest first, limits, restarts and files that can't be read."""

from __future__ import annotations

import os
import pickle
import time
import tracemalloc

import pytest

from tessera.streaming import ingest, polling


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def write(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def poll(spark, folder, work, each, **options):
    stream = polling.accepted(spark, str(folder), **options)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{work}/check").trigger(availableNow=True).start().awaitTermination()


def test_each_version_once_over_restarts(spark, tmp_path, store):
    folder, seen = tmp_path / "in", []
    note = lambda rows, batch: seen.extend((r["key"], r["modified"] // 1_000_000) for r in rows.collect())
    poll(spark, folder, tmp_path, note)
    assert seen == []
    now = int(time.time()) - 1000
    write(folder, "a/x.md", "one", now)
    write(folder, "b.md", "two", now + 5)
    write(folder, "_hidden/c.md", "no", now)
    poll(spark, folder, tmp_path, note)
    assert sorted(seen) == [("a/x.md", now), ("b.md", now + 5)]
    write(folder, "late.md", "of an older time", now - 20)  # within the look-back
    write(folder, "b.md", "two, changed", now + 9)
    poll(spark, folder, tmp_path, note)
    poll(spark, folder, tmp_path, note)
    assert sorted(seen[2:]) == [("b.md", now + 9), ("late.md", now - 20)]


def test_small_files_come_together(spark, tmp_path, store):
    """Many keys are looked up in one call, and many contents given in one frame; a large file comes by itself."""
    import pandas as pd

    class State(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        getMapState = getValueState = lambda self, *_, **__: State()

    p = polling._AcceptOnce(1000)
    p.init(Handle())
    f = pd.DataFrame([(f"/in/{i % 300}", str(i % 300), i // 300, 5) for i in range(600)], columns=["path", "key", "modified", "length"])
    got = list(p.handleInputRows((3,), iter([f]), None))
    assert len(got) == 1 and sorted(zip(got[0]["key"], got[0]["modified"], strict=True)) == sorted((str(i % 300), i // 300) for i in range(600))
    assert not list(p.handleInputRows((3,), iter([f]), None))

    for i in range(40):
        write(tmp_path, f"{i}.md", "x" * (3 << 20 if i > 37 else i), 100)
    files = spark.createDataFrame([(f"{tmp_path}/{i}.md", f"{i}.md", 100, 3 << 20 if i > 37 else i) for i in range(41)], polling.FILE).coalesce(1)
    rows = {r["key"]: r for r in polling.with_content(files).collect()}
    assert len(rows) == 41 and rows["40.md"]["error"] and all(len(rows[f"{i}.md"]["content"]) == (3 << 20 if i > 37 else i) for i in range(40))


def test_the_reader_goes_on_oldest_first(tmp_path):
    for i, at in enumerate((50, 10, 30, 20, 20, 40)):
        write(tmp_path, f"{i}.txt", "x" * i, at)
    reader = polling._Poll({"path": str(tmp_path), "maxFilesPerTrigger": 2, "lookBackSeconds": 0})
    offset, batches = reader.initialOffset(), []
    while (after := reader.latestOffset()) != offset:
        batches.append([r[1] for p in reader.partitions(offset, after) for r in reader.read(p)])
        offset = after
    assert batches == [["1.txt", "3.txt", "4.txt"], ["2.txt", "5.txt"], ["0.txt"]]


def test_the_driver_holds_no_listing(tmp_path):
    """What the driver holds doesn't grow with the files; tasks read all of them, also again, until the batch is committed."""
    folder, listings = tmp_path / "in", tmp_path / "listings"
    for i in range(5000):
        write(folder, f"{i % 7}/{i}.md" if i % 3 else f"{i}.md", "x" * (i % 5), 100 + i)
    write(folder, "_hidden/c.md", "no", 100)
    (folder / "nothing.md").symlink_to(folder / "gone.md")
    (folder / "linked.md").symlink_to(folder / "1" / "1.md")
    reader = polling._Poll({"path": str(folder), "filesPerPartition": 100, "listings": str(listings)})
    start = reader.initialOffset()
    reader.latestOffset()
    tracemalloc.start()
    end = reader.latestOffset()
    partitions = reader.partitions(start, end)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 600_000 and max(len(pickle.dumps(p)) for p in partitions) < 500 and len(partitions) == 51
    names = {(f"{i % 7}/{i}.md" if i % 3 else f"{i}.md"): i for i in range(5000)} | {"linked.md": 1}
    for _ in range(2):
        rows = [r for p in partitions for r in polling._Poll({"path": str(folder)}).read(p)]
        assert sorted(rows) == sorted((f"{folder}/{k}", k, (100 + i) * 1_000_000, i % 5) for k, i in names.items())
    reader.commit(start)
    assert len(os.listdir(listings)) == 1
    polling._Poll({"path": str(folder), "listings": str(listings)}).commit(end)  # after a restart
    assert os.listdir(listings) == [] and reader.latestOffset() == end


def test_index_of_accepted_files(spark, tmp_path, store):
    folder = tmp_path / "in"
    write(folder, "a.md", "alpha beta", 100)
    write(folder, "big.md", "x" * 600, 100)
    write(folder, "gone.md", "x", 100)
    parse = lambda rows: rows.selectExpr("key", "modified", "decode(content, 'UTF-8') AS text", "CASE WHEN length > 500 THEN 'too large' ELSE error END AS error")
    index = polling.index_accepted(f"{tmp_path}/index", parse)

    def each(rows, batch):
        if batch == 0:
            (folder / "gone.md").unlink(missing_ok=True)
        index(rows, batch)
        if fails:
            raise RuntimeError(fails.pop())

    fails = []
    poll(spark, folder, tmp_path, each)
    write(folder, "a.md", "gamma delta epsilon", 200)
    fails.append("stopped after the batch was written")
    with pytest.raises(Exception, match="stopped after"):
        poll(spark, folder, tmp_path, each)
    poll(spark, folder, tmp_path, each)  # runs the batch again
    assert [(r["source"], r["chunk"]) for r in ingest.latest(spark, f"{tmp_path}/index").collect()] == [("a.md", "gamma delta epsilon")]
    failed = {r["key"]: r["error"] for r in spark.read.parquet(f"{tmp_path}/index_failed").collect()}
    assert failed.keys() == {"big.md", "gone.md"} and failed["big.md"] == "too large"

"""The store of vectors: collections, replacement, removal and what a look-up reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.sources.vectors import VectorStore

SCHEMA = "source string, id int, embedding array<double>"


def rows(*specs):
    return [(s, i, [float(v)] * n) for s, i, n, v in specs]


def state(store):
    return sorted((r["source"] or "", r["id"], len(r["embedding"]), r["embedding"][0]) for r in store.all().collect())


def test_replacement_equals_a_plain_store(spark, tmp_path):
    r = random.Random(6)
    store, want = VectorStore(spark, str(tmp_path / "v"), buckets=4, files=2), {}
    for step in range(4):
        new = [(r.choice(["a", "b", "c", None]), i, r.choice([2, 3]), step) for i in range(12)]
        store.replace(spark.createDataFrame(rows(*new) + [("d", 99, None)], SCHEMA))
        touched = {(s, n) for s, _, n, _ in new}
        want = {k: v for k, v in want.items() if k not in touched}
        for s, i, n, v in new:
            want.setdefault((s, n), []).append((s or "", i, n, float(v)))
        assert state(store) == sorted(x for v in want.values() for x in v)
    store.remove(["a", None])
    assert state(store) == sorted(x for (s, _), v in want.items() for x in v if s in ("b", "c"))
    store.remove(["b", "c"])
    assert store.all() is None or store.all().count() == 0


def test_what_a_look_up_reads(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), buckets=8, files=1)
    assert store.all() is None and store.collections().count() == 0
    wanted = spark.createDataFrame([("small", 2), ("large", 4)], "name string, size int")
    assert store.missing(wanted).count() == 2
    store.replace(spark.createDataFrame(rows(*[(f"s{i}", i, n, 1) for i in range(40) for n in (2, 3)]), SCHEMA))
    found = store.read(2, ["s1", "s7"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dimension" in plan.split("PartitionFilters")[1].split("\n")[0] and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert sorted(r["id"] for r in found.collect()) == [1, 7] and store.read(3).count() == 40
    # files of other partitions are not opened
    assert found.select(F.input_file_name().alias("f")).distinct().count() <= 2
    assert {r["dimension"]: r["vectors"] for r in store.collections().collect()} == {2: 40, 3: 40}
    assert [r["name"] for r in store.missing(wanted).collect()] == ["large"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), buckets=8, files=3)
    store.replace(spark.createDataFrame(rows(*[(f"s{i % 20}", i, 2, 1) for i in range(200)]), SCHEMA))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "v").rglob("*.parquet")}
    before = files()
    store.replace(spark.createDataFrame(rows(("s3", 900, 2, 5)), SCHEMA))
    after = files()
    assert {p.parent for p in before.keys() - after.keys()} == {p.parent for p in after.keys() - before.keys()}
    assert len({p.parent for p in after.keys() - before.keys()}) == 1
    assert store.read(2, ["s3"]).count() == 1 and store.all().count() == 191

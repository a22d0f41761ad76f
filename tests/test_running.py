"""Running sums and budgets on groups that hold most rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import running


def table(n=4000):
    r = random.Random(5)
    return [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randint(0, 500), i, r.choice([0, 1, 1, 7, 40, None])) for i in range(n)]


def plain(rows):
    out, total = {}, {}
    for g, o, i, s in sorted(rows, key=lambda x: (x[1], x[2])):
        total[g] = total.get(g, 0) + (s or 0)
        out[i] = total[g]
    return out


def test_totals_equal_a_plain_loop(spark):
    rows = table()
    df = spark.createDataFrame([(*x, "x") for x in rows], "g string, o int, i int, size int, _part string").repartition(7)
    want = plain(rows)
    got = running.totals(df.drop("_part"), "g", ["o", "i"], "size").collect()
    assert {r["i"]: r["total"] for r in got} == want
    capped = running.totals(df.drop("_part"), "g", ["o", "i"], "size", most=300).collect()
    assert {r["i"] for r in capped} == {i for i, t in want.items() if t <= 300}
    assert running.totals(df.limit(0).drop("_part"), "g", ["o"], "size").count() == 0


def test_a_hot_group_is_dealt_to_many_tasks(spark):
    """Nine tenths of the rows are one group's; no part of it has more than a third."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), "id", F.lit(1).alias("size"))
        dealt = df.repartitionByRange("g", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in dealt) < 20_000 / 3
        out = running.totals(df, "g", ["id"], "size")
        assert out.groupBy("g").agg(F.max("total").alias("m")).orderBy("g").collect()[1]["m"] == 18_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_budget_equals_a_plain_loop(spark):
    rows = [(g, o, i, (s or 0) + 1) for g, o, i, s in table()]
    df = spark.createDataFrame(rows, "g string, o int, i int, size int")
    sums = plain(rows)
    want = {i for g, o, i, s in rows if sums[i] - s < 100}
    got = running.spent(df, "g", [F.col("o"), F.col("i")], F.col("size"), 100)
    assert {r["i"] for r in got.collect()} == want

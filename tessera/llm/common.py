"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import let as let
from tessera.session import ship
from tessera.session import table as table

#: Rows of an Arrow batch: a batch of the longest texts still fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Bytes of the texts of a labelled sample.
SAMPLE_BYTES = 64 << 20


#: Spark's setting for the removal of a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written by stored() that discard() has not removed yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one if driver and
    executors are one process, else an error, as no other folder is known to be shared."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again, which cuts its lineage for good; its shuffle files, which nothing reads
    again, go at once. discard() removes the table. codec: of the files, if not the session's; zstd takes less disk for texts."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """The tables that stored() has written in this process and discard() has not removed."""
    return set(_written)


def discard(spark: SparkSession, but: set[str], keep: DataFrame) -> None:
    """Removes the tables of stored() but for those in `but` and the one that `keep` reads. For callers whose results no longer read them."""
    used = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _written if p not in but and p.rsplit("/", 1)[1] not in used]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _written.remove(path)


def spread_join(rows: DataFrame, by: DataFrame, key: str, times: str | None = None, hot: int = 10_000, salts: int = 64) -> DataFrame:
    """`rows` with the columns of `by`, which has each key once, inner. Keys with more than `hot` rows are dealt to `salts` tasks; what is
    broadcast for that is a key for each `hot` rows at most. times: the column of `by` that counts a key's rows, if it has one; it goes."""
    counts = by.select(key, F.col(times).alias("_n")) if times else rows.groupBy(key).agg(F.count("*").alias("_n"))
    many = F.broadcast(counts.where(F.col("_n") > hot).select(key, F.lit(True).alias("_hot")))
    dealt = rows.withColumn("_place", F.xxhash64(*rows.columns)).join(many, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod("_place", F.lit(salts))).otherwise(0).cast("int"))
    each = (by.drop(times) if times else by).join(many, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("_hot", "_place").join(each.drop("_hot"), [key, "_salt"]).drop("_salt")


#: Ids up to which a list of rows is broadcast: 16 MB of them.
BROADCAST_IDS = 2_000_000


def only(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose `key` is among `ids`: broadcast if these have been counted to be few, so that wide rows needn't be shuffled, else by a shuffle.
    With how="left_anti", the other rows, those without a key among them."""
    ids = stored(ids.select(key).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def cut(df: DataFrame) -> DataFrame:
    """`df` after a reliable checkpoint, for small tables of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def python_ready(spark: SparkSession) -> None:
    """Gives executors this package and bounds the Arrow batches that their Python workers get, by rows and bytes.

    The bounds are settings of the session, as Spark plans a result only when it is asked for. Smaller ones of the caller stay.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(setting) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(setting, most)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[list[tuple[str, int]], float]:
    """At most `rows` (text, 0 or 1) of the labelled documents that are not held out, and the log-odds of label 1
    among all of them less those of the sample.

    Each label gives up to half of the rows, those with the smallest hashes of doc_id whose texts have SAMPLE_BYTES together, so that the
    sample doesn't depend on partitions and fits the driver. Of rows that share a doc_id, the smallest text counts. Rows without a label
    or a doc_id give nothing.
    """
    marked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.distinct().join(docs.select("doc_id").where(F.col("doc_id").isNotNull()), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # twice as many as are wanted, by a bound on the hash, so that what is ranked doesn't grow with the labels
    bound = {y: int(-(2**63) + min(1.0, rows / max(counts.get(y, 0), 1)) * (2**64 - 2**12)) for y in (0, 1)}
    first = Window.partitionBy("y").orderBy("h", "doc_id")
    low = marked.where(F.col("h") <= F.when(F.col("y") == 1, bound[1]).otherwise(bound[0]))
    picked = low.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows // 2)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def of(ids: DataFrame) -> DataFrame:  # ids has at most `rows` rows
        return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "rank").agg(F.min("text").alias("text"))

    chosen, sizes = [], [0, 0]
    for r in sorted(of(picked).select("doc_id", "y", "rank", F.octet_length("text").alias("size")).collect(), key=lambda r: (r["rank"], r["y"])):
        if sizes[r["y"]] + r["size"] <= SAMPLE_BYTES // 2:
            sizes[r["y"]] += r["size"]
            chosen.append((r["doc_id"], r["y"], r["rank"]))
    if not chosen:
        return [], 0.0
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, rank int")
    got = sorted(of(ids).collect(), key=lambda r: (r["rank"], r["y"]))
    n = {y: sum(r["y"] == y for r in got) for y in (0, 1)}
    shift = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)) - math.log((n[1] + 0.5) / (n[0] + 0.5))
    return [(r["text"], r["y"]) for r in got], shift

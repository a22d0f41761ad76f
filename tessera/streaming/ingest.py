"""Streaming ingestion: files in, each version once, replace-by-source out, with a ledger and a dead-letter table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tessera.functions import text as T
from tessera.operators import ingest

LEDGER = "key string, version string, status string, batch bigint"


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 20) -> DataFrame:
    """path, modificationTime, length, content of files as they come, oldest first."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return stream.option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def index_batches(index: str, ledger: str, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that indexes (source, version, chunk_no, chunk) rows.

    parse: from files to rows with key, version, text and error. Each batch writes its chunks into a folder of its own number,
    then its ledger rows; a batch that is run again overwrites both, so a failure in between leaves no
    claim and no double. The live index is what latest() reads.
    """

    def each(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        claimed = stored(spark, ledger, LEDGER).where(F.col("batch") != batch)
        fresh = ingest.new_versions(parse(files), claimed).withColumn("batch", F.lit(batch).cast("bigint")).persist()
        good = fresh.where("error is null").select(F.col("key").alias("source"), "version", "text")
        ingest.chunks(good).write.mode("overwrite").parquet(f"{index}/batch={batch}")
        # a failed file gives no claim: it goes to the dead letters, and its next version is tried
        status = F.when(T.is_blank(F.col("text")), "empty").otherwise("indexed")
        fresh.where("error is null").select("key", "version", status.alias("status")).write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
        fresh.where("error is not null").select("key", "version", "error").write.mode("overwrite").parquet(f"{ledger}_failed/batch={batch}")
        fresh.unpersist()

    return each


def latest(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of each source's last batch: what came later has replaced what was there."""
    rows = spark.read.option("basePath", index).parquet(index)
    last = rows.groupBy("source").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["source", "batch"], "left_semi")

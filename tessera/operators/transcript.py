"""Timed segments: offsets, merges of several speakers, and gaps of a clip timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import running


def shifted(segments: DataFrame, chunk_seconds: float, chunk: str = "chunk") -> DataFrame:
    """Segments with start and end moved by the place of their chunk (from 0) in the recording."""
    by = F.col(chunk) * F.lit(float(chunk_seconds))
    return segments.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def chunk_of(second: Column, chunk_seconds: int) -> Column:
    return F.floor(second / chunk_seconds).cast("bigint")


def merge(segments: DataFrame, conversation: str, ties: tuple[str, ...] = ("track", "segment_no")) -> DataFrame:
    """conversation, transcript: `[HH:MM:SS] [track] text` lines by start, ties in the order of `ties`; blank text goes."""
    line = F.concat(F.lit("["), T.clock(F.col("start")), F.lit("] ["), F.col("track"), F.lit("] "), T.strip(F.col("text")))
    rows = segments.where(~T.is_blank(F.col("text"))).groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct("start", *ties, line.alias("line")))).alias("rows"))
    return rows.select(conversation, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("transcript"))


def joined(segments: DataFrame, key: str, separator: str = " ") -> DataFrame:
    """key, text: all segments' texts by start."""
    rows = F.array_sort(F.collect_list(F.struct("start", "segment_no", F.col("text"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias("text"))


def segment_lines(segments: DataFrame, key: str) -> DataFrame:
    """key, lines: `[start - end] text` with two decimals for each segment, by start."""
    line = F.format_string("[%.2f - %.2f] %s", F.col("start"), F.col("end"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("start", "segment_no", line.alias("line"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("lines"))


def gaps(clips: DataFrame, track: str = "track", offset: str = "offset", duration: str = "duration", tie: str = "clip_id", least: float = 0.001) -> DataFrame:
    """`clips` that have audio, with gap: the silence before each on its track; zero where it is `least` seconds or less."""
    end = F.lag(F.col(offset) + F.col(duration)).over(Window.partitionBy(track).orderBy(offset, tie))
    gap = F.col(offset) - F.coalesce(end, F.lit(0.0))
    return clips.where(F.col(duration) > 0).withColumn("gap", F.when(gap > least, gap).otherwise(0.0))


def within_cap(files: DataFrame, archive: str, size: str, order: str, cap: int) -> DataFrame:
    """Files of an archive up to a total size: those whose running sum is within the cap. An archive may have any number of files."""
    return running.totals(files, archive, [order], size, "_total", cap).drop("_total")


def find_files(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """`blocks` (name) with path: by whole name, else by its last part; those without a file go."""
    by_name = files.select(F.col("name"), F.col("path").alias("_exact"))
    by_base = files.groupBy(T.basename(F.col("name")).alias("_base")).agg(F.min("path").alias("_loose"))
    out = blocks.join(by_name, "name", "left").withColumn("_base", T.basename(F.col("name"))).join(by_base, "_base", "left")
    return out.withColumn("path", F.coalesce("_exact", "_loose")).where("path is not null").drop("_exact", "_loose", "_base")

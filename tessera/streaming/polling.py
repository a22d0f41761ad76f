"""Polling of a folder: each version of each file is accepted once, oldest first.

The source lists the folder at each trigger and gives what has changed since its offset, less a look-back for files that come with an older
time; an accept-once filter holds the last accepted version of each key in the state, for a limited time. So no batch reads a ledger: it costs the
listing, and the state of the keys that it brings. Files are described only (path, time, length) until they are accepted; then their content is read where it is used.
The driver holds no listing: it goes through the folder file by file, and writes what a batch brings, a partition at a time, to a file that tasks read.

A restarted query, or a batch that is run again, may list files again; the filter's state is restored with it, so nothing is accepted twice.
"""

from __future__ import annotations

import errno
import heapq
import os
import pickle
import stat
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import ingest
from tessera.session import shared_dir, ship
from tessera.streaming.cache import stream_ready

FILE = "path string, key string, modified bigint, length bigint"
#: Days for which a version is remembered; a file that is listed after it may be accepted again.
REMEMBER_DAYS = 30
#: Bytes of a file up to which it is read.
MOST_BYTES = 256 << 20
#: Buckets of keys, whose versions are looked up together. A checkpoint holds for one number of them.
BUCKETS = 1024
#: Bytes and number of small files whose contents are given together.
TOGETHER_BYTES, TOGETHER = 4 << 20, 500


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _entries(store, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether it is a folder, modified in microseconds, length) of the files and folders in a folder; none if it isn't there. A local
    folder is read as it is gone through, one of another store is listed at once."""
    from pyarrow import fs

    if not isinstance(store, fs.LocalFileSystem):
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.type in (fs.FileType.File, fs.FileType.Directory):
                yield f.path, f.type == fs.FileType.Directory, (f.mtime_ns or 0) // 1000, f.size or 0
        return
    try:
        found = os.scandir(folder)
    except FileNotFoundError:
        return
    with found:
        for e in found:
            try:
                s = e.stat()
            except OSError as error:
                if error.errno in (errno.ENOENT, errno.ENOTDIR, errno.ELOOP):  # gone since, or a link to nothing
                    continue
                raise
            if stat.S_ISREG(s.st_mode) or stat.S_ISDIR(s.st_mode):
                yield e.path, stat.S_ISDIR(s.st_mode), s.st_mtime_ns // 1000, s.st_size


class _Files(InputPartition):
    """A piece of a file of listings."""

    def __init__(self, listing: str, at: int, size: int) -> None:
        self.listing, self.at, self.size = listing, at, size


class _Poll(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("maxFilesPerTrigger", 0))
        self.back, self.slice = int(options.get("lookBackSeconds", 60)) * 1_000_000, int(options.get("filesPerPartition", 512))
        self.at: int | None = None
        self.listings = options.get("listings")

    def _listed(self) -> Iterator[tuple]:
        """(modified in microseconds, key, path, length), in no order. A folder that isn't there yet has no files."""
        store, root = _store(self.folder)
        open_folders = [_entries(store, root)]
        while open_folders:
            if (entry := next(open_folders[-1], None)) is None:
                open_folders.pop()
                continue
            path, is_folder, modified, size = entry
            if path.rpartition("/")[2].startswith(("_", ".")):
                continue
            if is_folder:
                open_folders.append(_entries(store, path))
            else:
                yield modified, path[len(root) :].lstrip("/"), path, size

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        """The time of the newest file, or of the maxFilesPerTrigger-th after what has been given; files of one time stay together."""
        start = -1 if self.at is None else self.at
        later = (r[0] for r in self._listed() if r[0] > start)
        self.at = max(heapq.nsmallest(self.most, later) if self.most else later, default=start)
        return {"modified": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Pieces of a file to which the listing is written, each of filesPerPartition files, the oldest first."""
        self.at = max(end["modified"], -1 if self.at is None else self.at)
        if start == end:
            return []
        if self.listings is None:
            self.listings = tempfile.mkdtemp(prefix="tessera-")
        store, folder = _store(self.listings)
        store.create_dir(folder)
        name, out = f"{end['modified']}-{uuid.uuid4().hex}", []
        rows = (r for r in self._listed() if start["modified"] - self.back < r[0] <= end["modified"])
        with store.open_output_stream(f"{folder}/{name}") as listing:
            while piece := sorted(islice(rows, self.slice)):
                packed = zlib.compress(pickle.dumps([(path, key, modified, size) for modified, key, path, size in piece]))
                out.append(_Files(f"{self.listings}/{name}", listing.tell(), len(packed)))
                listing.write(packed)
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, path = _store(partition.listing)
        with store.open_input_file(path) as listing:
            listing.seek(partition.at)
            yield from pickle.loads(zlib.decompress(listing.read(partition.size)))

    def commit(self, end: dict) -> None:
        """Deletes the listings of what is done, also those that a reader before a restart has left."""
        if self.listings is not None:
            store, folder = _store(self.listings)
            for path, *_ in list(_entries(store, folder)):
                if int(path.rpartition("/")[2].partition("-")[0]) <= end["modified"]:
                    store.delete_file(path)


class PolledFolder(DataSource):
    """Options: maxFilesPerTrigger (0: all), lookBackSeconds, filesPerPartition, listings (a folder of this stream's own, which driver and executors
    share and whose files go when their batch is committed; unset: a local one)."""

    @classmethod
    def name(cls) -> str:
        return "polled_folder"

    def schema(self) -> str:
        return FILE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Poll(self.options)


class _AcceptOnce(StatefulProcessor):
    """The last accepted version of each key of a bucket. Keys come many at a time, as a call for each would cost more than its look-up."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "key string", "modified bigint, length bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for f in rows:
            out = []
            files = sorted(f[["key", "modified", "length", "path"]].itertuples(index=False, name=None))
            for name, versions in groupby(files, key=lambda r: r[0]):
                before = last = self.last.getValue((name,))
                for _, modified, length, path in versions:
                    if last is None or (modified, length) > tuple(last):
                        last = (modified, length)
                        out.append((path, name, modified, length))
                if last is not before:
                    self.last.updateValue((name,), last)
            if out:
                yield pd.DataFrame(out, columns=["path", "key", "modified", "length"])

    def close(self) -> None:
        pass


def accepted(spark: SparkSession, folder: str, remember_days: int = REMEMBER_DAYS, **options: int | str) -> DataFrame:
    """A stream of FILE rows: each version of each file of a folder, once. A version is new if its time, or at the same time its length,
    is greater than that of the one accepted before. Without the option `listings` each start has a fresh folder for them, in which the last batch's stays."""
    stream_ready(spark)
    spark.dataSource.register(PolledFolder)
    reader = spark.readStream.format("polled_folder").option("listings", f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}")
    for k, v in options.items():
        reader = reader.option(k, v)
    listed = reader.load(folder)
    dealt = listed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_AcceptOnce(remember_days * 86_400_000), outputStructType=FILE, outputMode="Append", timeMode="ProcessingTime")


def with_content(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """FILE rows with content and error. What is gone, unreadable or over `most` bytes has an error and no content."""
    ship(files.sparkSession)

    columns = ["path", "key", "modified", "length", "content", "error"]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, size = [], 0
            for path, key, modified, length in f[["path", "key", "modified", "length"]].itertuples(index=False, name=None):
                content, error = None, None
                # large files are not in memory together
                if out and (size + min(length, most) > TOGETHER_BYTES or len(out) >= TOGETHER):
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
                try:
                    store, inner = _store(path)
                    if length > most:
                        error = "too large"
                    else:
                        with store.open_input_stream(inner) as stream:
                            content = stream.read()
                except OSError as e:
                    error = str(e)
                out.append((path, key, modified, length, content, error))
                size += len(content or b"")
            if out:
                yield pd.DataFrame(out, columns=columns)

    return files.mapInPandas(each, FILE + ", content binary, error string")


def index_accepted(index: str, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the chunks of accepted files below a folder of the batch's number, and what failed beside it. It reads nothing that
    earlier batches have written; a batch that is run again overwrites its own. parse: rows with key, modified, content and error to rows with text in
    place of content. What the streaming ingestion's latest() reads of an index holds for this one."""

    def each(files: DataFrame, batch: int) -> None:
        # first of all what was accepted, as the state gives it once
        files.write.mode("overwrite").parquet(f"{index}_accepted/batch={batch}")
        read = parse(with_content(files.sparkSession.read.schema(FILE).parquet(f"{index}_accepted/batch={batch}"))).persist()
        good = read.where("error IS NULL").select(F.col("key").alias("source"), F.col("modified").cast("string").alias("version"), "text")
        ingest.chunks(good).write.mode("overwrite").parquet(f"{index}/batch={batch}")
        read.where("error IS NOT NULL").select("key", "modified", "error").write.mode("overwrite").parquet(f"{index}_failed/batch={batch}")
        read.unpersist()

    return each

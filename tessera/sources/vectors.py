"""A store of vectors in Parquet: one collection for each dimension, partitioned by it, and within it by a bucket of the source.

A look-up of a dimension and some sources reads their buckets only. Sources are replaced by writing their buckets anew, each as a whole partition
(dynamic overwrite), so what a replacement reads and writes is bounded by the buckets that it touches, not by the store. A bucket is as many files as
`files` says, by the row's id, so that one source with a third of all vectors isn't one task's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a store adds to those of its rows.
DIMENSION, BUCKET = "dimension", "bucket"


class VectorStore:
    """source: the column by which vectors are replaced; vector: their column, of any length; id: what tells rows of a source apart.

    Rows with a null vector are not stored; a null source is a source of its own. The columns are those of the first write.
    """

    def __init__(self, spark: SparkSession, path: str, source: str = "source", vector: str = "embedding", id: str = "id", buckets: int = 16, files: int = 4) -> None:
        self.spark, self.path, self.source, self.vector, self.id, self.buckets, self.files = spark, path.rstrip("/"), source, vector, id, buckets, files

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(self.source).cast("string"), F.lit("\0"))), F.lit(self.buckets)).cast("int")
        return rows.where(F.col(self.vector).isNotNull()).withColumns({DIMENSION: F.size(self.vector), BUCKET: bucket})

    def _write(self, placed: DataFrame) -> None:
        dealt = placed.withColumn("_file", F.pmod(F.xxhash64(self.id), F.lit(self.files))).repartition(DIMENSION, BUCKET, "_file").drop("_file")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DIMENSION, BUCKET).parquet(self.path)

    def all(self) -> DataFrame | None:
        """Every row with its dimension and bucket; None of a store that isn't there yet."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def collections(self) -> DataFrame:
        """dimension, vectors: what the store has, of the partitions' footers."""
        rows = self.all()
        return self.spark.createDataFrame([], "dimension int, vectors bigint") if rows is None else rows.groupBy(DIMENSION).agg(F.count("*").alias("vectors"))

    def missing(self, wanted: DataFrame, dimension: str = "size") -> DataFrame:
        """The rows of `wanted` whose collection the store doesn't have, as before a first write."""
        rows = self.all()
        return wanted if rows is None else wanted.join(rows.select(F.col(DIMENSION).alias(dimension)).distinct(), dimension, "left_anti").select(*wanted.columns)

    def replace(self, rows: DataFrame) -> None:
        """Puts the sources of `rows` in place of what the store has of these, in each dimension that `rows` has; other sources and dimensions stay. A
        source that is given without vectors of a dimension keeps those of it; remove() takes a source away."""
        placed = self._placed(rows)
        old = self.all()
        if old is not None:
            touched = placed.select(DIMENSION, BUCKET).distinct()
            named = placed.select(DIMENSION, F.col(self.source).alias("_s")).distinct()
            # the touched partitions are few and known before the scan, so that the others are not read
            parts = [(r[DIMENSION], r[BUCKET]) for r in touched.collect()]
            here = old.where(self._within(parts))
            kept = here.join(named, (here[DIMENSION] == named[DIMENSION]) & here[self.source].eqNullSafe(named["_s"]), "left_anti")
            placed = kept.select(*placed.columns).unionByName(placed)
        self._write(placed)

    def _within(self, parts: list[tuple[int, int]]):
        """A filter of partitions: of each dimension its buckets. There are dimensions times buckets of them at most."""
        by: dict[int, list[int]] = {}
        for d, b in parts:
            by.setdefault(d, []).append(b)
        out = F.lit(False)
        for d, bs in sorted(by.items()):
            out = out | ((F.col(DIMENSION) == d) & F.col(BUCKET).isin(sorted(bs)))
        return out

    def _bucket_of(self, sources: Iterable) -> list[int]:
        kind = self.all().schema[self.source].dataType
        rows = self.spark.createDataFrame([(s,) for s in sources], f"{self.source} {kind.simpleString()}").withColumn(self.vector, F.array(F.lit(0.0)))
        return sorted(r[0] for r in self._placed(rows).select(BUCKET).distinct().collect())

    def remove(self, sources: Iterable) -> None:
        """Takes sources away, in all dimensions. Their buckets are written anew; one that has no other source is left empty of files."""
        sources, old = [*sources], self.all()
        if old is None or not sources:
            return
        here = old.where(F.col(BUCKET).isin(self._bucket_of(sources)))
        gone = self.spark.createDataFrame([(s,) for s in sources], f"_s {old.schema[self.source].dataType.simpleString()}")
        kept = here.join(F.broadcast(gone), here[self.source].eqNullSafe(gone["_s"]), "left_anti")
        before = {(r[0], r[1]) for r in here.select(DIMENSION, BUCKET).distinct().collect()}
        after = {(r[0], r[1]) for r in kept.select(DIMENSION, BUCKET).distinct().collect()}
        if after:
            self._write(kept.select(*old.columns))
        for d, b in sorted(before - after):
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{DIMENSION}={d}/{BUCKET}={b}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def read(self, dimension: int, sources: Iterable | None = None) -> DataFrame:
        """The vectors of a dimension, of all or of some sources. Only its partitions are read, and of those only the sources' buckets. A store that isn't
        there has no columns to give and raises."""
        rows = self.all()
        if rows is None:
            raise FileNotFoundError(self.path)
        rows = rows.where(F.col(DIMENSION) == dimension)
        if sources is not None:
            sources = [*sources]
            named = F.col(self.source).isin([s for s in sources if s is not None])
            named = named | F.col(self.source).isNull() if None in sources else named
            rows = rows.where(F.col(BUCKET).isin(self._bucket_of(sources)) & named)
        return rows.drop(DIMENSION, BUCKET)

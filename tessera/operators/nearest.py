"""The best vectors by cosine for any number of queries: blocks around pivots, skipped by the triangle inequality.

Vectors are scaled to length one, where the distance d of two gives their cosine, 1 - d²/2. Each goes to its nearest pivot and, by its distance from that, into a ring;
a ring of a pivot is a block. A vector of a block is at least |d(query, pivot) - d(vector, pivot)| from a query, so a block whose bound on the cosine is below
the k-th best that a query has already found can't hold a better one, and the query doesn't go there. Each query first visits the blocks that are likeliest
to be good, as many as have k vectors, and then those that this proof doesn't exclude.

Queries and vectors meet by a join on the block, in packed rows of bounded size, so neither goes through the driver and the plan is the same for
any number of them. What the driver sees are the pivots and, for each block, its size and range: PIVOTS times 2 / RING of them for each length of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expr import let
from tessera.session import ship

#: Pivots for each length of vectors, and the width of a ring in distance.
PIVOTS, RING = 64, 0.1
#: Vectors of a packed row, and queries of one, about.
PACK, QUERIES = 2048, 256
#: What rounding may add to a bound: scores are rounded to six digits.
SLACK = 2e-6


def _unit(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """i, v: vectors scaled to length one; those that are null, hold nulls or have no length go."""
    doubles = rows.where(F.col(embedding).isNotNull()).select(F.col(vec_id).cast("bigint").alias("i"), F.col(embedding).cast("array<double>").alias("_v")).where(~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return doubles.select("i", let(norm, lambda n: F.when(n > 0, F.transform("_v", lambda x: x / n))).alias("v")).where("v IS NOT NULL")


class Blocks:
    """Pivots by length of vectors, and for each block (length, pivot, ring) its number of vectors and least and greatest distance."""

    def __init__(self, pivots: dict[int, np.ndarray], stats: list[tuple] = ()) -> None:
        self.pivots, self.blocks = pivots, {}
        for length, pivot, ring, n, low, high in stats:
            self.blocks.setdefault(length, []).append((pivot, ring, n, low, high))
        self.table = {length: np.array(sorted(b)) for length, b in self.blocks.items()}
        self.pieces = {(length, int(p), int(r)): -(-int(n) // PACK) for length, t in self.table.items() for p, r, n, _, _ in t}

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (v @ self.pivots[v.shape[1]].T)))

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """[query, block]: the greatest cosine that a vector of the block can have."""
        t = self.table[v.shape[1]]
        d = self.distances(v)[:, t[:, 0].astype(int)]
        return 1 - np.maximum(0.0, np.maximum(d - t[:, 4], t[:, 3] - d)) ** 2 / 2


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for length, some in frame.groupby(frame["v"].map(len), sort=True):
        if length:
            yield some, np.stack(some["v"].to_numpy())


def blocks_of(unit: DataFrame) -> Blocks:
    """Of unit vectors (i, v): the pivots are those with the least hashes of each length."""
    first = Window.partitionBy("_n").orderBy(F.xxhash64("i"), "i")
    chosen = unit.withColumn("_n", F.size("v")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= PIVOTS).select("_n", "v").collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(r["_n"], []).append(r["v"])
    known = Blocks({n: np.array(v) for n, v in pivots.items()})
    stats = _placed(unit, known).groupBy("length", "pivot", "ring").agg(F.count("*"), F.min("d"), F.max("d")).collect()
    return Blocks(known.pivots, [tuple(r) for r in stats])


def _placed(unit: DataFrame, known: Blocks) -> DataFrame:
    """length, pivot, ring, piece, d, i, v of unit vectors."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for some, v in _by_length(f):
                d = known.distances(v)
                pivot = d.argmin(axis=1)
                near = d[np.arange(len(d)), pivot]
                ring = (near / RING).astype(int)
                pieces = np.array([known.pieces.get((v.shape[1], int(p), int(r)), 1) for p, r in zip(pivot, ring, strict=True)])
                mixed = (some["i"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield pd.DataFrame({"length": v.shape[1], "pivot": pivot, "ring": ring, "piece": (mixed % pieces.astype(np.uint64)).astype(int), "d": near, "i": some["i"].to_numpy(), "v": some["v"].to_numpy()})

    return unit.mapInPandas(each, "length int, pivot int, ring int, piece int, d double, i bigint, v array<double>")


BLOCK = ["length", "pivot", "ring"]


def visits(queries: DataFrame, known: Blocks, k: int, found: bool) -> DataFrame:
    """length, pivot, ring, i, v: the blocks that queries (i, v) go to. First, without found: those with the highest bounds until they have k vectors besides
    the query's own; then, of queries with `least`, the k-th score that each has (null: fewer than k), those of the rest whose bound isn't below it."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for some, v in _by_length(f):
                if v.shape[1] not in known.table:
                    continue
                t = known.table[v.shape[1]]
                bound = known.bounds(v)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(t[order, 2], axis=1) - t[order, 2]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < k + 1, axis=1)
                go = first
                if found:
                    least = some["least"].fillna(-np.inf).to_numpy(float)
                    go = ~first & (bound >= least[:, None] - SLACK)
                q, b = np.nonzero(go)
                yield pd.DataFrame({"length": v.shape[1], "pivot": t[b, 0].astype(int), "ring": t[b, 1].astype(int), "i": some["i"].to_numpy()[q], "v": some["v"].to_numpy()[q]})

    return queries.mapInPandas(each, "length int, pivot int, ring int, i bigint, v array<double>")


def _scored(asked: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of the visits `asked`, the k best of each packed row for each query."""
    per = asked.groupBy(*BLOCK).agg(F.ceil(F.count("*") / QUERIES).alias("_parts"))
    dealt = asked.join(per, BLOCK).withColumn("_part", F.pmod(F.xxhash64("i"), F.col("_parts")))
    groups = dealt.groupBy(*BLOCK, "_part").agg(F.collect_list("i").alias("q"), F.collect_list("v").alias("qv"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q, qv, at, v in f[["q", "qv", "ids", "vectors"]].itertuples(index=False, name=None):
                s = np.round(np.stack(qv) @ np.stack(v).T, 6)
                s[q[:, None] == at[None, :]] = -np.inf
                n = min(k, s.shape[1])
                # ties go to the smaller id: by score, then id
                order = np.lexsort((np.broadcast_to(at, s.shape), -s), axis=1)[:, :n]
                best = np.take_along_axis(s, order, axis=1)
                good = np.isfinite(best)
                yield pd.DataFrame({"query_id": np.repeat(q, n)[good.ravel()], "vec_id": at[order][good], "score": best[good]})

    return groups.join(packed, BLOCK).select("q", "qv", "ids", "vectors").mapInPandas(each, "query_id bigint, vec_id bigint, score double")


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: for each query the k vectors of its length most like it by cosine, but for those of its own id; ties to the smaller id.

    Fewer where there are fewer. Of queries that share an id one is asked. Null, zero and incomplete vectors take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    # a packed row is up to a few MB: some at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(256, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or 256))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    unit, asked = _unit(vectors, vec_id, embedding), _unit(queries, vec_id, embedding).dropDuplicates(["i"])
    known = blocks_of(unit)
    packed = _placed(unit, known).groupBy(*BLOCK, "piece").agg(F.collect_list("i").alias("ids"), F.collect_list("v").alias("vectors")).drop("piece")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = best(_scored(visits(asked, known, k, False), packed, k))
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("i"), F.col("score").alias("least"))
    rest = _scored(visits(asked.join(least, "i", "left"), known, k, True), packed, k)
    return best(first.drop("rank").unionByName(rest))


def share_visited(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """The share of all pairs of queries and vectors that topk() multiplies."""
    ship(vectors.sparkSession)
    unit, asked = _unit(vectors, vec_id, embedding), _unit(queries, vec_id, embedding).dropDuplicates(["i"])
    known = blocks_of(unit)
    found = topk(vectors, queries, k, vec_id, embedding).where(F.col("rank") == k).select(F.col("query_id").alias("i"), F.col("score").alias("least"))
    size = vectors.sparkSession.createDataFrame([(n, int(p), int(r), int(c)) for n, t in known.table.items() for p, r, c, _, _ in t], "length int, pivot int, ring int, n bigint")
    both = visits(asked, known, k, False).drop("v").unionByName(visits(asked.join(found, "i", "left"), known, k, True).drop("v"))
    return both.join(size, BLOCK).agg(F.sum("n")).first()[0] / max(1, asked.count() * unit.count())

"""Exact top-k by integer inner product over an impact-ordered index, read score-at-a-time.

Vectors are split into blocks. A block's index has a list of postings for each component, cut into segments of equal
quantised value. For a query, a segment's impact is the largest product that it can add or take away. Segments are processed
in descending order of impact, whatever component they belong to, and each adds its least contribution to its vectors'
accumulators. What the segments left can still do to a vector is bounded twice: by the next impact times the number of its
components left, and, after Cauchy and Schwarz, by the length of the rest of the query times that of the rest of the vector. Processing
stops on the proof that all but few vectors are below the k best so far, or after the last segment; those few are
scored exactly.

A block's vectors come to one task and are indexed once; the queries follow them in batches, so a task holds one
index and one batch. Each query gives k rows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import python_ready, stored

LEVELS = 128
BLOCK_ROWS = 16_384
#: Looks for the proof: one after each of so many equal parts of the postings, from the FIRST on. The part of a block that may be left to score exactly.
LOOKS, FIRST, FEW = 16, 8, 16
#: Components, and scores, are held within these.
MOST, LONGEST = 1 << 62, (1 << 63) - 1


class Index:
    """Of one block: vectors as int64 rows, their ids ascending. read, of: postings processed, and those of all queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        n, dims = self.v.shape
        self.read = self.of = 0
        self.most = max(int(self.v.max(initial=0)), -int(self.v.min(initial=0)))
        if dims * self.most * self.most >= MOST:  # scored as it is: its sums would leave 64 bits
            return
        low, high = self.v.min(axis=0, initial=0), self.v.max(axis=0, initial=0)
        width = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (self.v - low) // width + np.arange(dims) * LEVELS
        rows = np.argsort(level.T.ravel(), kind="stable")
        counts = np.bincount(level.ravel(), minlength=dims * LEVELS)
        some = np.flatnonzero(counts)
        self.counts, self.rows = counts[some], (rows % n if n else rows).astype(np.int32)  # postings, by segment
        self.component = some // LEVELS
        first = low[self.component] + some % LEVELS * width[self.component]
        self.first, self.last = first, np.minimum(first + width[self.component] - 1, high[self.component])
        self.largest = np.maximum(np.abs(self.first), np.abs(self.last))
        self.smallest = np.where((self.first <= 0) & (self.last >= 0), 0, np.minimum(np.abs(self.first), np.abs(self.last)))
        self.width = width
        self.squares = (self.v * self.v).sum(axis=1)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best other than the vector `own`; ties to the smaller id."""
        mine = slice(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right"))
        largest = max(int(q.max(initial=0)), -int(q.min(initial=0)))
        if len(q) * max(self.most, largest) ** 2 >= MOST:
            maybe, by = np.arange(len(self.ids)), self.v.astype(object)
            scores = np.array([max(-LONGEST, min(LONGEST, x)) for x in (by @ q.astype(object)).tolist()], np.int64) if len(q) else np.zeros(len(maybe), np.int64)
        else:
            maybe = self.possible(q, mine, k)
            scores = self.v[maybe] @ q
        other = self.ids[maybe] != own
        maybe, scores = maybe[other], scores[other]
        best = np.lexsort((self.ids[maybe], -scores))[:k]
        return self.ids[maybe][best], scores[best]

    def possible(self, q: np.ndarray, mine: slice, k: int) -> np.ndarray:
        """The rows that the segments processed don't rule out of the k best of all but `mine`."""
        n = len(self.ids)
        others = n - (mine.stop - mine.start)
        if others <= k or not len(self.counts):
            return np.arange(n)
        w = q[self.component]
        impact = np.abs(w) * self.largest
        least = np.minimum(w * self.first, w * self.last).astype(float)
        order = np.argsort(-impact, kind="stable")
        ends = np.searchsorted(np.cumsum(self.counts[order]), np.arange(1, LOOKS + 1) * (len(self.rows) / LOOKS)) + 1
        spread = float((np.abs(q) * (self.width - 1)).sum())  # quantisation, over all components
        sums, q_left, v_left, left = np.zeros(n), np.full(n, float(q @ q)), self.squares.astype(float), np.full(n, len(q))
        at, maybe = 0, np.arange(n)
        self.of += len(self.rows)
        for look in range(FIRST - 1, LOOKS):
            new = np.zeros(len(order), bool)
            new[order[at : ends[look]]] = True
            at = min(int(ends[look]), len(order))
            rows = self.rows[np.repeat(new, self.counts)]
            add = lambda values: np.bincount(rows, np.repeat(values[new], self.counts[new]), n)  # noqa: B023, E731
            sums += add(least)
            q_left -= add((w * w).astype(float))
            v_left -= add((self.smallest * self.smallest).astype(float))
            left -= np.bincount(rows, minlength=n)
            following = float(impact[order[at]]) if at < len(order) else 0.0
            rest = np.minimum(np.sqrt(np.maximum(q_left, 0) * np.maximum(v_left, 0)), following * left) * (1 + 1e-9) + 1e-6
            lower = sums - rest
            lower[mine] = -np.inf  # stays below all others, so the bound is that of the others
            maybe = np.flatnonzero(sums + rest + spread >= np.partition(lower, n - k)[n - k])
            if at >= len(order) or len(maybe) <= max(4 * k, n // FEW):
                break
        self.read += int(self.counts[order[:at]].sum())
        return maybe


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(256 * x) of each component, within -2^62 and 2^62. Vectors that are null or hold null or non-finite
    components, and rows with a null id, go."""
    e: Column = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    held = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * 256))).cast("bigint")
    return vectors.where(F.col(vec_id).isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(e, held).alias("v"))


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that `queries` (of vec_id) holds for.

    Scores are inner products of the quantised components; ties go to the smaller vec_id. Only vectors of the query's
    length are candidates. Rows that share an id are candidates with that id each, never of a query with it; a query id that comes more
    than once is asked with its smallest vector. Empty vectors score 0. Quantised components beyond 2^62 count as 2^62, and scores
    beyond a long as the longest one. An empty table gives no rows.
    """
    python_ready(vectors.sparkSession)
    rows = stored(quantised(vectors, vec_id, embedding).withColumn("dims", F.size("v")))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    blocks = max(vectors.sparkSession.sparkContext.defaultParallelism * 2, -(-rows.count() // BLOCK_ROWS))
    right = rows.select("vec_id", "v", "dims", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    left = asked.select("vec_id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    # each block's vectors, then all queries, so that the index is built once and what a task holds doesn't grow with the queries
    both = right.unionByName(left).repartition(blocks, "block").sortWithinPartitions("block", "dims", "asks")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, index = None, [], None
        for frame in frames:
            out: list[tuple[np.ndarray, ...]] = []
            for at, part in frame.groupby(["block", "dims", "asks"]):
                if at[:2] != key:
                    key, held, index = at[:2], [], None
                if not at[2]:
                    held.append((part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), -1)))
                    continue
                if held:
                    index = Index(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                    held = []
                if index is not None:
                    for own, q in zip(part["vec_id"].tolist(), part["v"], strict=True):
                        ids, scores = index.top(np.asarray(q, np.int64), own, k)
                        out.append((np.full(len(ids), own), ids, scores))
            yield pd.DataFrame({x: np.concatenate([r[i] for r in out]) if out else np.zeros(0, np.int64) for i, x in enumerate(("query_id", "vec_id", "score"))})

    found = both.mapInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query's result by brute force.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

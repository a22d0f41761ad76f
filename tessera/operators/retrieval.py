"""Vector search, source de-duplication and context assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import Retrieval
from tessera.functions import text as T
from tessera.functions.vectors import cosine
from tessera.operators import nearest, running

#: Query vectors that one pass over the vectors answers; more of them meet the vectors in blocks.
QUERY_BLOCK = 1024
# The words around a context.
OPENING = "<rag_context>\nThe following context may be relevant. Use it only if it helps; otherwise ignore it.\n\n"
CLOSING = "</rag_context>"


def vector_topk(vectors: DataFrame, query: list[float], k: int = 5, threshold: float | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, score: the k vectors most like the query by cosine; ties to the smaller id. The threshold is inclusive."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(vec_id, F.round(cosine(F.col(embedding), q), 6).alias("score"))
    scored = scored.where(F.col("score") >= threshold) if threshold is not None else scored.where("score is not null")
    return scored.orderBy(F.col("score").desc(), vec_id).limit(k)


def vector_threshold(vectors: DataFrame, query: list[float], threshold: float = Retrieval.threshold, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(vec_id, F.round(cosine(F.col(embedding), q), 6).alias("score")).where(F.col("score") >= threshold)


def vector_topk_many(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: the k best of all vectors for each query but itself.

    Up to QUERY_BLOCK queries are one matrix for each length of vectors, which goes over the vectors once; every batch of vectors gives its k best a query. More than that
    meet the vectors in blocks around pivots (nearest.topk), so neither the driver nor the plan grows with them. Both are exact.
    """
    rows = queries.select(F.col(vec_id).cast("bigint").alias("i"), F.col(embedding).alias("v")).where("v is not null").limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        return nearest.topk(vectors, queries, k, vec_id, embedding)
    dims: dict[int, list] = {}
    for r in (r for r in rows if None not in r["v"] and any(r["v"])):  # as in blocks, a query without a direction has none that are like it
        dims.setdefault(len(r["v"]), []).append((r["i"], r["v"]))
    best = [_block_topk(vectors, [i for i, _ in dims[n]], np.array([v for _, v in dims[n]], float), k, vec_id, embedding) for n in sorted(dims)]
    if not best:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    found = best[0]
    for b in best[1:]:
        found = found.unionByName(b)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_topk(vectors: DataFrame, ids: list[int], matrix: np.ndarray, k: int, vec_id: str, embedding: str) -> DataFrame:
    norms = np.linalg.norm(matrix, axis=1)
    unit = np.where(norms[:, None] > 0, matrix / np.maximum(norms, 1e-300)[:, None], 0.0)

    def each(frames):
        own = np.array(ids)
        for f in frames:
            f = f[[v is not None and len(v) == unit.shape[1] for v in f["v"]]]
            if not len(f):
                continue
            v, at = np.stack(f["v"].to_numpy()).astype(float), f["i"].to_numpy()
            n = np.linalg.norm(v, axis=1)
            v, at = v[n > 0] / n[n > 0, None], at[n > 0]
            scores = np.round(unit @ v.T, 6)
            for q in range(len(own)):
                s = np.where(at == own[q], -np.inf, scores[q])
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                top = near[np.lexsort((at[near], -s[near]))][:k]
                top = top[np.isfinite(s[top])]
                yield pd.DataFrame({"query_id": own[q], "vec_id": at[top], "score": s[top]})

    return vectors.select(F.col(vec_id).cast("bigint").alias("i"), F.col(embedding).alias("v")).mapInPandas(each, "query_id bigint, vec_id bigint, score double")


def sources(candidates: DataFrame, config: Retrieval = Retrieval(), request: list[str] = ()) -> DataFrame:
    """The first candidate of each source in rank order, as (request..., bucket, key, name, rank).

    candidates: rank, score, bucket, key, source, title, display_name. A key falls back to the source, a blank bucket to the default,
    a name to the title and the key's last part; rows without a key or a score go.
    """
    key = T.first_nonblank(F.col("key"), F.col("source"))
    bucket = F.coalesce(T.nonblank(F.col("bucket")), F.lit(config.default_bucket))
    rows = candidates.where(F.col("score").isNotNull()).select(*request, "rank", bucket.alias("bucket"), key.alias("key"), "display_name", "title").where("key is not null")
    first = F.min_by(F.struct("display_name", "title"), "rank")
    named = rows.groupBy(*request, "bucket", "key").agg(F.min("rank").alias("rank"), first.alias("f"))
    return named.select(*request, "bucket", "key", T.first_nonblank(F.col("f.display_name"), F.col("f.title"), T.basename(F.col("key"))).alias("name"), "rank")


def budget(candidates: DataFrame, request: str, rank: list[Column], config: Retrieval = Retrieval()) -> DataFrame:
    """`candidates` with snippet: by rank, as much of each text as the request's budget of characters has left. Blank texts are
    skipped before they are charged, rows beyond the budget go. A request may have any number of candidates."""
    rows = running.spent(candidates.where(~T.is_blank(F.col("text"))), request, rank, F.length("text"), config.context_chars, "_used")
    return rows.withColumn("snippet", F.substring("text", F.lit(1), (F.lit(config.context_chars) - F.col("_used")).cast("int"))).drop("_used")


def context_block(snippets: DataFrame, request: str, rank: str) -> DataFrame:
    """request, context: the opening sentence, each snippet with an empty line, the closing tag. snippets: as budget() returns."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank), "snippet")))
    body = F.array_join(F.transform(rows, lambda r: F.concat(r["snippet"], F.lit("\n\n"))), "")
    return snippets.groupBy(request).agg(F.concat(F.lit(OPENING), body, F.lit(CLOSING)).alias("context"))


def source_files(found: DataFrame, objects: DataFrame, ttl_seconds: int, config: Retrieval = Retrieval(), mimes: list[str] | None = None) -> DataFrame:
    """Sources whose object exists and is within the size limit, and of one of `mimes` if these are given, with the columns of objects(bucket, key,
    size, mime, ...) and a link's life of 1 to 60 minutes."""
    life = F.lit(max(60, min(3600, ttl_seconds)))
    out = found.join(objects, ["bucket", "key"]).where(F.col("size") <= config.max_source_bytes).withColumn("ttl_seconds", life)
    return out.where(F.lower("mime").isin(*mimes)) if mimes is not None else out

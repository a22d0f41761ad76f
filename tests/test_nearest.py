"""Top-k of many queries by blocks around pivots, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import nearest, retrieval

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, ids, k):
    out = []
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and any(v)]
    for q in sorted({i for i, _ in good if i in ids}):
        qv = next(v for i, v in good if i == q)
        scored = [(-round(float(qv @ v) / float(np.linalg.norm(qv) * np.linalg.norm(v)), 6), i) for i, v in good if i != q and len(v) == len(qv)]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda x: (x[0], x[3]))


def clustered(n=1500, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.08 * r.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n + i, centres[i % 3].tolist()) for i in range(60)]  # equal vectors: ties by id
    rows += [(n + 100 + i, r.normal(size=5).tolist()) for i in range(7)] + [(n + 200, [0.0] * 16), (n + 201, None), (n + 202, [1.0, None]), (n + 203, [])]
    return rows


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[3]) == (w[0], w[3]) and abs(g[2] - w[2]) <= 1.1e-6 and (g[1] == w[1] or abs(g[2] - w[2]) > 0)


@pytest.mark.parametrize("k", [1, 7])
def test_equals_all_pairs(spark, k):
    rows = clustered()
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = nearest.topk(vectors, vectors.where("vec_id % 13 = 0 OR vec_id >= 1500"), k).collect()
    near(sorted((tuple(r) for r in got), key=lambda x: (x[0], x[3])), plain(rows, {i for i, _ in rows if i % 13 == 0 or i >= 1500}, k))


def test_blocks_are_skipped(spark, monkeypatch):
    """Of clustered vectors most are proved to be too far; with small packs, so that a block is in several rows."""
    vectors = spark.createDataFrame([r for r in clustered(3000) if r[1] and len(r[1]) == 16], SCHEMA)
    share = nearest.share_visited(vectors, vectors.where("vec_id % 20 = 0"), 5)
    assert 0 < share < 0.3


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = clustered(300)
    vectors = spark.createDataFrame(rows, SCHEMA)
    one = {(r["query_id"], r["rank"]): r["score"] for r in retrieval.vector_topk_many(vectors, vectors, 3).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    many = {(r["query_id"], r["rank"]): r["score"] for r in retrieval.vector_topk_many(vectors, vectors, 3).collect()}
    assert one.keys() == many.keys() and all(abs(one[x] - many[x]) < 2e-6 for x in one)
    none = vectors.limit(0)
    assert nearest.topk(none, none).count() == 0 and nearest.topk(vectors, none).count() == 0 and nearest.topk(none, vectors).count() == 0

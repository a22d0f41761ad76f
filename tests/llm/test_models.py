"""Classifiers, language models, shards, top-k and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, lm, quality, queries, sharding, topk, toxicity
from tessera.llm.common import labelled_sample
from tests.conftest import duck, normal

SF = "/root/testdata/sf0.001"
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def made(n, toxic, r):
    """Texts of which every third is toxic, or of bad quality."""
    rows = []
    for i in range(n):
        w = [word(r) for _ in range(r.randint(20, 200))]
        if i % 3 == 0 and toxic:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(["zugbrol", "kwimpaf", "vixxort"])
        elif i % 3 == 0:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + " |" for x in w]
        rows.append((i, " ".join(w), int(i % 3 == 0) if toxic else int(i % 3 != 0)))
    return rows


def test_the_driver_trains_no_toxicity_model_itself(spark):
    """What training takes stays with the process that trains; the model is that of train()."""
    import tracemalloc

    r = random.Random(4)
    sample = [(" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(150)), i % 2) for i in range(200)]
    tracemalloc.start()
    got = toxicity.score(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(sample)], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sample)], "doc_id bigint, toxic int"), "toxic")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.columns == ["doc_id", "text", "score", "predicted"] and most < 30 << 20
    here, there = toxicity.train(sample, 0.5), toxicity.fitted(spark, sample, 0.5)
    assert np.array_equal(here.gains, there.gains) and (here.a, here.b, here.bias, here.spreads) == (there.a, there.b, there.bias, there.spreads)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, module, label):
    rows = made(900, label == "toxic", random.Random(1))
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(5000, None, 0.5, "x"), (5001, "", 0.5, "x"), (None, "a b", 0.5, "x"), (5002, "ha " * 100_000, 0.5, "x")], "doc_id bigint, text string, score double, y string")
    labels = spark.createDataFrame([(i, y, 9) for i, _, y in rows] + [(None, 1, 9), (5, None, 9), (77777, 1, 9)], f"doc_id bigint, {label} int, text int")
    out = {r["doc_id"]: r for r in module.score(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i]["predicted"] == y for i, y in held) >= 0.95 * len(held)
    assert len(out) == 904 and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[5000]["score"] == out[5001]["score"] and out[5000]["y"] == "x"


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_labels_or_rows(spark, module):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    label = "toxic" if module is toxicity else "quality"
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}
    assert module.score(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(3)], f"doc_id bigint, {label} int")
    assert len({r["score"] for r in module.score(docs, one).collect()}) == 1


def test_misspellings_share_subwords():
    r = random.Random(1)
    model = toxicity.train([(t, y) for _, t, y in made(600, True, r)])
    model.learn_words([["zugbrol", "zugbroll", "xzugbrol", "thereon"]])
    assert min(model.known["zugbroll"], model.known["xzugbrol"]) > model.known["thereon"] + 5


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    rows = [(i, f"t{i}") for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 4 == 0) for i in range(200)], "doc_id bigint, y boolean")
    sample, shift = labelled_sample(docs, labels, "y", 40)
    assert len(sample) == 40 and sum(y for _, y in sample) == 20 and shift < 0
    assert all(zlib.crc32(t[1:].encode()) % 5 for t, _ in sample)


def test_dual_coordinate_descent_separates():
    r = np.random.default_rng(0)
    y = np.where(r.random(200) < 0.5, 1.0, -1.0)
    rows = [np.array([0, 1 + i % 5, 6 if t > 0 else 7]) for i, t in enumerate(y)]
    w = quality.descend(rows, [np.ones(3)] * 200, y, 8)
    assert all((w[i].sum() > 0) == (t > 0) for i, t in zip(rows, y, strict=True))


def plain_lm(background, target):
    """Losses by counting in dictionaries."""
    chars = Counter(c for t in [*background, *target] for c in t)
    known = {c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], ord(x[0])))[: lm.VOCABULARY - 2]}
    v = lm.VOCABULARY

    def grams(texts):
        out = Counter()
        for t in texts:
            s = ["<", "<", *(c if c in known else "?" for c in t)]
            out.update(zip(s, s[1:], s[2:], strict=False))
        return out

    b, t = grams(background), grams(target)
    scale = sum(t.values()) / sum(b.values())

    def loss(three):
        two, one, ctx2, ctx1 = Counter(), Counter(), Counter(), Counter()
        for (x, y, z), n in three.items():
            two[y, z] += n
            one[z] += n
            ctx2[x, y] += n
            ctx1[y] += n
        total = sum(one.values())

        def f(text):
            s = ["<", "<", *(c if c in known else "?" for c in text)]
            out = 0.0
            for x, y, z in zip(s, s[1:], s[2:], strict=False):
                p1 = (one[z] + 1) / (total + v)
                p2 = (two[y, z] + lm.PRIOR * p1) / (ctx1[y] + lm.PRIOR)
                out -= math.log((three[x, y, z] + lm.PRIOR * p2) / (ctx2[x, y] + lm.PRIOR))
            return out / max(len(text), 1)

        return f

    return loss(t), loss(Counter({k: n * scale for k, n in b.items()}))


def test_cross_entropy_difference_equals_plain_counts(spark):
    r = random.Random(2)
    docs = [" ".join(word(r) for _ in range(r.randint(1, 80))) for _ in range(60)] + ["", "日本", "x", "ha" * 5000, "".join(map(chr, range(300, 600)))]
    target = [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(30)) for _ in range(5)]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*docs, None])], "doc_id bigint, text string, score int")
    models = lm.train(d, spark.createDataFrame([(t,) for t in [*target, None]], "text string"))
    t, b = plain_lm(docs, target)
    for row in lm.score(d, models).collect():
        text = docs[row["doc_id"]] if row["doc_id"] < len(docs) else ""
        assert row["n_tokens"] == len(text)
        assert row["target_loss"] == pytest.approx(t(text), abs=1e-4) and row["background_loss"] == pytest.approx(b(text), abs=1e-4)
        assert row["score"] == row["target_loss"] - row["background_loss"]
    liked = lm.score(spark.createDataFrame([("alpha beta gamma",), ("theron anre",)], "text string"), models).collect()
    assert liked[0]["score"] < liked[1]["score"]


def test_cross_entropy_knows_all_characters(spark, monkeypatch, tmp_path):
    """Far more characters than VOCABULARY, and two rare scripts of which the target has one."""
    r = random.Random(3)
    many = ["".join(chr(r.randint(0x4E00, 0x4E00 + 400)) for _ in range(300)) for _ in range(20)]
    greek, cyrillic = ["".join(chr(r.randint(low, low + 20)) for _ in range(60)) for low in (0x3B1, 0x430)]
    docs, target = [*many, *many[:3], greek, cyrillic, "", "a", "\U0001f600\x00é"], [greek[:50], many[0], ""]
    columns = "doc_id bigint, text string"
    spark.createDataFrame([*enumerate(docs), (len(docs), None)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), columns).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {x["doc_id"]: x for x in queries.op5_cross_entropy(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs) + 1 and list(rows[0].asDict()) == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    monkeypatch.setattr(lm, "VOCABULARY", len(set("".join(docs))) + 2)
    t, b = plain_lm(docs, target)
    for i, text in enumerate([*docs, ""]):
        assert rows[i]["n_tokens"] == len(text) and rows[i]["score"] == rows[i]["target_loss"] - rows[i]["background_loss"]
        assert rows[i]["target_loss"] == pytest.approx(t(text), abs=1e-6) and rows[i]["background_loss"] == pytest.approx(b(text), abs=1e-6)
    assert rows[len(many) + 3]["score"] < rows[len(many) + 4]["score"]


def test_cross_entropy_of_blocks_and_empty_tables(spark, monkeypatch):
    r = random.Random(5)
    docs = [" ".join(word(r) for _ in range(r.randint(0, 40))) for _ in range(50)]
    d, none = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    want = {x["doc_id"]: x["score"] for x in lm.score(d, lm.train(d, d.limit(5))).collect()}
    for chars, held in ((1, 1), (500, 3), (1 << 21, 1 << 20)):
        monkeypatch.setattr(lm, "BLOCK_CHARS", chars)
        monkeypatch.setattr(lm, "HELD", held)
        got = {x["doc_id"]: x["score"] for x in lm.differences(d, d, d.limit(5)).collect()}
        assert got == pytest.approx(want, abs=1e-5)
    assert lm.differences(none, none, none).count() == 0
    one = lm.differences(d.where("doc_id = 7"), none, none).first()
    assert one["score"] == 0 and one["target_loss"] == pytest.approx(math.log(lm.VOCABULARY), abs=1e-9)


def test_language_models_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    models = lm.train(none, none)
    rows = lm.score(spark.createDataFrame([("abc",), (None,)], "text string"), models).collect()
    assert [r["score"] for r in rows] == [0.0, 0.0] and rows[0]["target_loss"] == pytest.approx(math.log(lm.VOCABULARY), abs=1e-5)


def shards_of(spark, rows):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, shard int, name int")
    return sharding.shard(d).toPandas()


def test_shards(spark):
    r = random.Random(3)
    rows = [(i, " ".join(word(r) for _ in range(r.randint(1, 60)))) for i in range(3000)]
    rows += [(3000 + i, "the very same page " * 20) for i in range(1500)] + [(5000, None), (5001, ""), (None, "x"), (5002, "é" * 3)]
    got = shards_of(spark, rows)
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.01 * sizes.mean() + 1
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter(zip(got["size"], got["text_crc32"], strict=True)) == want
    apart = got[got["size"] != len("the very same page " * 20) + 1].groupby("text_crc32")["shard"].nunique()
    assert apart.max() == 1  # copies stay together unless they are too many for one shard


def test_shards_of_few_rows(spark):
    assert len(shards_of(spark, [])) == 0
    assert sorted(shards_of(spark, [(1, "a"), (1, "a"), (2, None)])["slot"]) in ([0, 0, 0], [0, 0, 1], [0, 1, 2])


def test_packing_balances_every_measure():
    r = random.Random(4)
    items = [(f"b{i}", float(r.randint(1, 1000)), float(r.randint(1, 300)), float(r.randint(1, 9))) for i in range(2000)]
    placed = sharding.pack(items, 16)
    for k, share in ((1, 0.003), (2, 0.02), (3, 0.02)):
        sums = Counter()
        for x in items:
            sums[placed[x[0]]] += x[k]
        assert max(sums.values()) - min(sums.values()) < share * sum(sums.values()) / 16


def vectors(spark, n=400, dims=8, seed=5):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1 + (d == 0)) for d in range(dims)], 0) for i in range(n)]
    rows += [(n + i, rows[3 % n][1], 0) for i in range(5)] + [(n + 10, None, 0), (n + 11, [1.0] * (dims - 1) + [None], 0), (n + 12, [math.nan] * dims, 0), (n + 13, [math.inf] * dims, 0), (n + 50, [0.0] * dims, 0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")


@pytest.mark.parametrize(("rows", "dims"), [(400, 8), (3, 2), (900, 64)])
def test_topk_equals_brute_force(spark, monkeypatch, rows, dims):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 150)
    monkeypatch.setattr(common, "BATCH_ROWS", 5)
    v = vectors(spark, rows, dims)
    frame = v.select("vec_id", "embedding").toPandas()
    theirs = duck(topk.TOPK_SQL, embeddings=frame)
    assert normal(topk.search(v, F.col("vec_id") % 50 == 0).toPandas()) == normal(theirs)


def test_topk_stops_on_proof():
    r = np.random.default_rng(1)
    v = r.integers(-50, 50, (4000, 16))
    v[7] = 4000
    index = topk.Index(np.arange(4000), v)
    ids, scores = index.top(np.full(16, 3), -1, 1)
    assert ids.tolist() == [7] and scores.tolist() == [4000 * 3 * 16]
    assert index.read < 0.6 * index.of


def test_topk_stops_on_proof_on_the_test_vectors(spark):
    """Vectors of no structure: the worst case for a bound. Every query leaves postings unread, and the result is exact."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    v = np.floor(np.array([x["embedding"] for x in rows], float) * 256).astype(np.int64)
    ids = np.array([x["vec_id"] for x in rows])
    index, before = topk.Index(ids, v), 0
    for i in range(0, len(v), 50):
        found, scores = index.top(v[i], ids[i], 5)
        plain = v @ v[i]
        want = sorted((-int(s), int(d)) for s, d in zip(plain, ids, strict=True) if d != ids[i])[:5]
        assert [(-s, d) for s, d in zip(scores.tolist(), found.tolist(), strict=True)] == want
        assert index.read - before < len(index.rows)
        before = index.read
    assert index.read < 0.75 * index.of


def test_topk_of_huge_components(spark):
    """Sums that leave 64 bits are exact within, and end at a long's bounds."""
    rows = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [0.0, 2.0]), (4, [1e300, 0.0]), (5, [1e-3, 1e-3])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.search(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    most = (1 << 63) - 1
    assert got == [(1, most), (4, most), (3, 512 * 256), (5, 0), (2, -most)]


@pytest.mark.parametrize("copies", [8, 700, 1999])
def test_topk_of_repeated_query_ids(spark, copies):
    """Rows with the query's own id stand above all others and are none of its neighbours."""
    r = np.random.default_rng(4)
    v = r.normal(size=(2000, 8))
    v[:copies] = v[0] * 3
    ids = np.where(np.arange(2000) < copies, 0, np.arange(2000))
    q = np.floor(v * 256).astype(np.int64)
    want = sorted((-int(q[i] @ q[0]), i) for i in range(copies, 2000))[:5]
    found, scores = topk.Index(ids, q).top(q[0], 0, 5)
    assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want
    table = spark.createDataFrame(list(zip(ids.tolist(), v.tolist(), strict=True)), "vec_id bigint, embedding array<double>")
    got = topk.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(-x["score"], x["vec_id"]) for x in got] == want and [x["rank"] for x in got] == list(range(1, len(want) + 1))


def test_topk_of_an_empty_table_and_other_lengths(spark):
    v = vectors(spark)
    assert topk.search(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    mixed = spark.createDataFrame([(0, [1.0]), (1, [1.0, 1.0]), (2, [2.0]), (3, [])], "vec_id bigint, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.search(mixed, F.col("vec_id") == 0).collect()] == [(2, 512 * 256)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pseudonyms", "bpe"]
    seen, kept = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF)
        kept.append(seen.count())
        if name != "bpe":
            assert seen.columns == docs.columns
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.7 * kept[0]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == kept[-1] and out.where("ids_sha256 IS NULL").count() == 0


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "call +1 (988) 555-2485", None, "s", 22)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for rows in (docs, docs.limit(0)):
        seen = rows
        for _, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, SF)
        assert seen.count() == (2 if rows is docs else 0)  # texts without words are copies of each other


def test_every_query_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)

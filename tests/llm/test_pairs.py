"""Decontamination and SimHash classes against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontam, simhash
from tests.conftest import duck, normal

DOCS = "doc_id bigint, text string, cell string, fp int, item_id int, h int"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(n)]
    near = [(1000 + i, t + (" tail" if i % 3 else "")) for i, t in rows[:20]]
    odd = [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "one"), (2004, "One"), (2005, "ÄÖ ü"), (2006, "äÖ ü"), (7, rows[7][1]), (None, rows[8][1]), (None, "zzz")]
    return rows + near + odd


def frame(spark, rows, kind=DOCS):
    return spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in rows], kind)


def plain_fingerprint(text):
    import xxhash

    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("dense", [64, 1])
def test_components_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE_CELL", dense)
    rows = corpus()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == brute(rows)


def fingerprint_chain():
    """Values that are linked in a long chain, in a tight ball, and not at all."""
    chain, x = [], 0
    for i in range(0, 60, 2):
        x |= 3 << i
        chain.append(x)
    ball = [0xF0F0 << 40 ^ (1 << a) for a in range(40)]
    return chain + ball + [random.Random(5).getrandbits(63) for _ in range(40)]


@pytest.mark.parametrize(("dense", "grids"), [(64, (8, 16)), (64, (16,)), (2, (8, 16)), (0, (8, 16)), (0, ())])
def test_links_of_chains_and_balls(spark, monkeypatch, dense, grids):
    monkeypatch.setattr(simhash, "DENSE_CELL", dense)
    monkeypatch.setattr(simhash, "SEGMENTS", grids)
    values = fingerprint_chain()
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a != b and bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    classes = {}
    for v in values:
        classes.setdefault(find(v), set()).add(v)
    got = {}
    for r in simhash._classes(spark.createDataFrame([(v,) for v in set(values)], "fp bigint")).collect():
        got.setdefault(r["root"], set()).add(r["fp"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_links_across_the_border_of_a_dense_cell(spark):
    """Cell (2, 2) is dense, (4, 2) next to it, (5, 2) and (6, 2) are out of its reach."""
    dense = [(1 << a | 1 << b) | (1 << c | 1 << d) << 8 for a in range(8) for b in range(a) for c in range(8) for d in range(c)][:100]
    border = [0b11110000 | 0b11 << 8, 0b11111000 | 0b11 << 8, 0b11111011 | 0b11 << 8]
    values = [*dense, *border]
    assert len(dense) > simhash.DENSE_CELL
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a != b and bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    got = {r["fp"]: r["root"] for r in simhash._classes(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()}
    assert len(got) == len(values) and len(set(got.values())) == len({find(v) for v in values})
    assert got[border[0]] == got[border[1]] == got[border[2]]


def test_unlike_fingerprints_hardly_meet(spark, monkeypatch):
    """Joins make rows for links, not for fingerprints whose counts are near by chance, which grow with the square."""
    made, kind = [], type(spark.range(1))
    join = kind.join

    def counted(self, *args, **more):
        made.append(join(self, *args, **more))
        return made[-1]

    fps = common.stored(spark.range(20_000).select(F.xxhash64("id").alias("fp")))
    monkeypatch.setattr(kind, "join", counted)
    links = simhash._links(fps)
    monkeypatch.undo()
    assert links.where("a <> b").count() == 0
    assert max(df.count() for df in made) <= 2 * 20_000  # each meets itself


@pytest.mark.parametrize("segments", [4, 8])
def test_each_pair_within_two_bits_shares_a_cell(spark, segments):
    r = random.Random(9)
    signed = lambda x: x - (x >> 63 << 64)
    pairs = [(x, x ^ 1 << a) for x in (0, r.getrandbits(64)) for a in range(64)] + [(x, x ^ 1 << a ^ 1 << b) for x in (r.getrandbits(64), (1 << 64) - 1) for a in range(64) for b in range(a)]
    ends = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a bigint, b bigint").distinct()
    fps = ends.selectExpr("a as fp").union(ends.selectExpr("b as fp")).distinct()
    cells, probes = simhash._placed(fps, segments), simhash._placed(fps, segments, probes=True)
    met = probes.withColumnRenamed("fp", "a").join(cells.withColumnRenamed("fp", "b"), "cell").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    assert ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(met, ["a", "b"], "left_anti").count() == 0


def plain_sets(text, words=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain_classes(rows, similarity=0.8):
    """The number of the class of each row, by comparing all pairs."""
    sets, parent = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= similarity * len(a | b) > 0:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_copies(seed, sizes, copies):
    """Texts, and copies of each in which so many words are changed that most stay within the similarity and some don't; all texts share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7)))
    passage, rows = [word() for _ in range(12)], []
    for size in sizes:
        base = [word() for _ in range(size)]
        base[size // 2 : size // 2] = passage
        rows.append(base)
        for _ in range(copies):
            w = [*base]
            for _ in range(r.randint(0, max(1, size // 40))):
                w[r.randrange(len(w))] = word()
            rows.append(w)
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_range_counts_differ_by_no_more_than_the_sets():
    import numpy as np

    r = np.random.default_rng(3)
    for n, other in ((5, 3), (200, 20), (200, 400), (40_000, 9_000)):
        a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], r.integers(0, 1 << 64, other, dtype=np.uint64)]))
        apart = int(np.abs(simhash.range_counts(a) - simhash.range_counts(b)).sum())
        assert apart <= len(np.setxor1d(a, b))
    assert simhash.range_counts(np.array([], np.uint64)).sum() == 0


def test_deduplicate_equals_comparing_all_pairs(spark):
    rows = near_copies(11, [1, 4, 6, 9, 20, 40, 60, 63, 66, 75, 90, 130, 400, 1500], 6)
    rows += [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "One"), (2003, "one"), (None, "zzz"), (None, rows[3][1]), (5, rows[5][1])]
    kept = simhash.deduplicate(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "cell", "fp", "item_id", "h"]
    classes = plain_classes(rows)
    want = {}
    for (d, t), c in zip(rows, classes, strict=True):
        want[c] = min(want.get(c, (True, 0)), (d is None, d or 0))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert got == sorted(want.values()) and len(got) < 0.6 * len(rows)


def test_a_key_loses_no_pair(spark, monkeypatch):
    """One key is all that the texts share, so neither its smallest one nor HUBS others find all pairs at 0.8."""
    monkeypatch.setattr(simhash, "rarest", lambda units, similarity: units.select("unit", "n", F.lit(1).cast("bigint").alias("key")))
    monkeypatch.setattr(simhash, "BLOCK", 7, raising=False)
    rows = near_copies(12, [20, 30, 40, 55], 12)
    want = {}
    for (d, _), c in zip(rows, plain_classes(rows), strict=True):
        want[c] = min(want.get(c, d), d)
    assert sorted(x["doc_id"] for x in simhash.deduplicate(frame(spark, rows)).collect()) == sorted(want.values()) and len(want) < 0.7 * len(rows)


@pytest.mark.parametrize("copies", [40, 160])
def test_candidates_grow_with_a_group_and_not_with_its_square(spark, monkeypatch, copies):
    """Copies that are nearer to one text, not their smallest one, than to each other hardly meet but by it."""
    r, word = random.Random(14), lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7)))
    base, rows = [word() for _ in range(150)], []
    for i in range(copies):
        w = [*base]
        for _ in range(3):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows.append((copies, " ".join(base)))
    made, plain = [], simhash.stored

    def counted(df, *args):
        out = plain(df, *args)
        if df.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    want = {}
    for (d, _), c in zip(rows, plain_classes(rows), strict=True):
        want[c] = min(want.get(c, d), d)
    assert sorted(x["doc_id"] for x in simhash.deduplicate(frame(spark, rows)).collect()) == sorted(want.values())
    assert 0 < sum(made) <= 8 * len(rows), made


def test_deduplicate_removes_its_sets_and_compresses_its_texts(spark):
    import os

    import pyarrow.parquet as pq

    rows, before = near_copies(13, [20, 60, 90, 400], 6), common.written()
    kept = simhash.deduplicate(frame(spark, rows)).count()
    assert kept == len(set(plain_classes(rows)))
    left = {}
    for path in common.written() - before:
        folder = path.removeprefix("file://")
        left[path] = [pq.ParquetFile(f"{folder}/{x}") for x in os.listdir(folder) if x.endswith(".parquet")]
    assert not [p for p, files in left.items() if any("set" in f.schema_arrow.names for f in files)]
    groups = [f.metadata.row_group(0) for files in left.values() for f in files if "text" in f.schema_arrow.names and f.num_row_groups]
    assert groups and all(g.column(i).compression == "ZSTD" for g in groups for i in range(g.num_columns))


@pytest.mark.parametrize("ids", [0, 1000])
def test_probes_and_keys_that_meet_nothing_are_not_shuffled_with_the_others(spark, monkeypatch, ids):
    """With lists of ids that are broadcast and with lists that are too long for it."""
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    seen, plain = [], common.only
    monkeypatch.setattr(simhash, "only", lambda rows, keys, key, how="left_semi": seen.append(key) or plain(rows, keys, key, how))
    got = {tuple(sorted((x["a"], x["b"]))) for x in simhash._links(spark.createDataFrame([(v,) for v in (0, 1, 3, 7, 1 << 40, 255 << 8)], "fp bigint")).collect()}
    assert got == {(0, 1), (0, 3), (1, 3), (1, 7), (3, 7), (0, 1 << 40), (1, 1 << 40)} and "cell" in seen
    spread = spark.createDataFrame([(1, 9, 5), (2, 8, 5), (3, 7, 6), (2, 8, 7), (4, 6, 7), (5, 5, 7)], "unit bigint, n int, key bigint")
    assert sorted(map(tuple, simhash.meetings(spread).select("key", "unit", "n", "hub", "hub_n").collect())) == [(5, 1, 9, 1, 9), (5, 2, 8, 1, 9), (7, 2, 8, 2, 8), (7, 4, 6, 2, 8), (7, 5, 5, 2, 8)]


@pytest.mark.parametrize("ids", [0, 1000])
def test_hub_of_a_key_is_its_smallest_unit_or_the_most_central_one(spark, monkeypatch, ids):
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    spread = spark.createDataFrame([(1, 9, 5), (2, 8, 5), (3, 7, 6), (2, 8, 7), (4, 6, 7), (5, 5, 7)], "unit bigint, n int, key bigint")
    hubs = lambda **how: sorted(map(tuple, simhash.meetings(spread, **how).select("key", "unit", "n", "hub", "hub_n").collect()))
    assert hubs() == [(5, 1, 9, 1, 9), (5, 2, 8, 1, 9), (7, 2, 8, 2, 8), (7, 4, 6, 2, 8), (7, 5, 5, 2, 8)]
    assert hubs(central=True) == [(5, 1, 9, 2, 8), (5, 2, 8, 2, 8), (7, 2, 8, 2, 8), (7, 4, 6, 2, 8), (7, 5, 5, 2, 8)]


def test_parts_of_large_sets_lose_few_pairs():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (100, 190, 1000, 20_000):
        lost = 0
        for _ in range(150):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.permutation(len(a))[: -max(1, n // 9)]], r.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
            lost += not set(simhash.part_keys(a, 0.8)) & set(simhash.part_keys(b, 0.8))
        assert lost <= 2
    unlike = [set(simhash.part_keys(np.unique(r.integers(0, 1 << 63, 500, dtype=np.uint64)), 0.8)) for _ in range(20)]
    assert not any(x & y for i, x in enumerate(unlike) for y in unlike[:i])


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string, doc_id int")
    assert decontam.leaks(none, items).count() == 0
    assert decontam.leaks(frame(spark, [(1, "a b c d e")]), items).count() == 0
    assert decontam.clean(frame(spark, [(1, "a b c d e"), (None, "x")]), items).count() == 2


ITEMS = [(1, "the quick brown fox jumps over the lazy dog today"), (2, "the quick brown fox jumps over the lazy dog today"), (3, ""), (4, None), (5, "short one"), (None, "the quick brown fox jumps"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (6, "another text of this very same item"), (8, "word"), (9, "text of this"), (10, "in four words here")]
LEAKY = [
    (1, "Well: the QUICK, brown fox jumps over the lazy dog today! " + "filler word " * 400), (2, "the quick brown fox jumps over the lazy cat"), (3, "short one"), (4, "a short one"), (5, None), (6, ""),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (7, "nothing"), (9, "and a WORD, too"), (None, "the quick brown fox jumps over the lazy dog today"), (8, "Another text of this very same item, again"),
]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_leaks_equal_the_twin(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    docs = frame(spark, LEAKY + LEAKY)
    got = decontam.leaks(docs, items).toPandas()
    theirs = duck(decontam.LEAKS_SQL, documents=docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}), benchmark=items.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    assert normal(got) == normal(theirs)
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == {(1, 1), (1, 2), (1, 8), (3, 5), (4, 5), (7, 6), (8, 6), (8, 9), (9, 8)}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 5, 6, None}


def test_no_leak_is_lost_at_any_size(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(r.sample(words, n))) for i, n in enumerate([5, 6, 9, 17, 40, 150])]
    docs = []
    for i, t in items:
        w = t.split()
        for k in range(6):
            cut = w[: max(5, len(w) - r.randint(0, max(1, len(w) // 4)))]
            docs.append((100 * i + k, " ".join(r.sample(words, 300)) + " " + " ".join(cut) + " " + " ".join(r.sample(words, 300))))
    it, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    assert normal(decontam.leaks(d, it).toPandas()) == normal(duck(decontam.LEAKS_SQL, documents=d.toPandas(), benchmark=it.toPandas()))


def test_native_only(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = decontam.leaks(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan

"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into segments, four of 16 bits. Two fingerprints within two bits differ in two segments at most, in whose bit counts they are at
Manhattan distance two at most, and are equal in all others. So for each two segments there is a grid of cells that count the bits of these and keep
the others as they are, and a range join on these grids, of 22 cells that a fingerprint looks up with the six that it is under, finds every
pair within reach; an exact test of the Hamming distance follows. A cell that kept counts only would be met by more fingerprints the more there are, linked or
not; of these cells hardly any is met by one that isn't linked, so the work grows with the fingerprints and their links.

Cells that hold many fingerprints would meet quadratically, so the join leaves them out, and the fingerprints that are under them or look them up go
through the finest grid, of 64 segments of one bit, whose cells are the fingerprints themselves: two of them within two bits share a cell that is within one bit
of both, so each is put under its 65 cells at distance one or less, and all under one cell are linked to the
smallest. A cell has at most 65 fingerprints, so no group is large, and the work is linear in the number of
fingerprints however dense the grid gets. Those that look dense cells up take part in the coarser join, too, as they may be within
reach of some that are not.

deduplicate() links texts by the Jaccard similarity of their shingles, which fingerprints of whole texts are too coarse to search for: texts at 0.8
differ in some ten bits, and so do unrelated ones among many. It also takes fingerprints of parts. A text's shingles are dealt by their hashes into
as many parts as make SHARE shingles each at most, and PARTS of these are fingerprinted; similar texts have some parts that are
equal, at distance zero. Texts of few shingles have too few parts for that; two of them share one of their rarest shingles, so these are
looked up. Candidates from any search are verified exactly; those whose counts of shingle hashes by range already differ too much are left
out before, as the Manhattan distance of these counts is no larger than the number of shingles that one text has and the other has not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import cut, discard, only, python_ready, spread_join, stored, written

#: Segments of the grids, from coarse to fine, even numbers. The finest one, of 64, needs no join.
SEGMENTS = (4,)
#: Cells with more fingerprints than this are searched by the next finer grid, with all that look them up.
DENSE_CELL = 64
REACH = 2
#: Tasks among which the links of one value are dealt.
SALTS = 8
#: Of deduplicate(): units of a key's block; all pairs of two blocks meet in a task.
BLOCK = 256
#: Most shingles of a part on average, parts that are fingerprinted, and shingles up to which rare ones are looked up instead.
SHARE, PARTS, FEW = 6, 16, 64
#: Ranges by which shingle hashes are counted.
RANGES = 256


def shingles(text: str | None, words: int) -> tuple[bytes, bytes]:
    """The words of a text, joined by a space, and the eight-byte hashes of its shingles, repeats included, one after the other."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, both know ASCII only
    joined, digest = b" ".join(w), xxhash.xxh64_digest
    if len(w) <= words:
        return joined, digest(joined, 42) if w else b""
    starts = np.cumsum([0] + [len(x) + 1 for x in w])
    n = len(w) - words + 1
    return joined, b"".join([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (starts[words:] - 1).tolist(), strict=True)])


def _majority(hashes: bytes) -> int:
    """The signed 64-bit SimHash of some hashes; zero of none."""
    import numpy as np

    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of a text: a bit is set where over half of the shingles' hashes have it."""
    return _majority(shingles(text, words)[1])


def part_keys(distinct, similarity: float) -> list[int]:
    """Keys of the parts of a set of shingle hashes (ascending, unsigned 64-bit) that sets as similar as that share some of; none
    for a set of up to FEW. The number of all parts is a power of two; a set near the next one gives the parts of both.
    """
    import numpy as np

    n, out = len(distinct), []
    mix = lambda x, tag: (x * 0x9E3779B97F4A7C15 + tag * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) - (1 << 63)
    if n > FEW:
        for level in {int(np.ceil(np.log2(n / SHARE))), int(np.ceil(np.log2(n / similarity / SHARE)))}:
            part = (distinct >> np.uint64(7)) & np.uint64((1 << level) - 1)
            few = part < PARTS
            order = np.argsort(part[few], kind="stable")
            part, rows = part[few][order], distinct[few][order].astype(">u8").view(np.uint8).reshape(-1, 8)
            starts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            if len(starts):
                sizes = np.diff([*starts, len(part)])
                bits = np.add.reduceat(np.unpackbits(rows, axis=1).astype(np.int32), starts, axis=0) * 2 > sizes[:, None]
                prints = np.packbits(bits, axis=1).view(">u8").ravel()
                out += [mix(f, level * PARTS + p) for f, p in zip(prints.tolist(), part[starts].tolist(), strict=True)]
    return out


def range_counts(distinct):
    """Of a set of unsigned 64-bit hashes, how many are in each of RANGES equal ranges, 127 at most: of two sets, these differ by no more,
    summed up, than the sets do."""
    import numpy as np

    return np.bincount((distinct >> np.uint64(56)).astype(np.int64), minlength=RANGES).clip(max=127)


def maybe_similar(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) of units(unit, n, counts) that can have the similarity by their counts: sets of it differ in
    (1 - similarity) / (1 + similarity) of their sizes' sum at most. `b` may have many `a`. Counts of units without a pair are not shuffled."""
    of = only(units.select("unit", "n", "counts"), pairs.select(F.explode(F.array("a", "b")).alias("unit")), "unit")
    both = spread_join(pairs, of.toDF("b", "n_b", "counts_b"), "b").join(of.toDF("a", "n_a", "counts_a"), "a")
    apart = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda total, x: total + x)
    return both.where(apart <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)).select("a", "b")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", into: str = "fp") -> DataFrame:
    """`docs` with the fingerprint of `text` as a bigint. Null and empty texts have 0."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("bigint")
    def each(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in parts:
            yield pa.array([fingerprint(t, words) for t in s.to_pylist()], pa.int64())

    return docs.withColumn(into, each(F.col(text)))


def _steps(segments: int, probes: bool) -> list[tuple[int, int, int, int, int]]:
    """The cells of a grid that a fingerprint is put under or, as a probe, looks up: the bits that a cell keeps, the places of the two segments whose
    bits it counts, and what is added to these counts.

    Two fingerprints within two bits differ in two segments at most. If in two, each count differs by one; if in one, by two, by one or, where
    bits change places, by none, and a cell that counts the segment and its neighbour will do. Of two fingerprints one looks the other up, the one
    with less in the first segment that differs by count.
    """
    width, out = 64 // segments, []
    for i, j in combinations(range(segments), 2):
        kept = (1 << 64) - 1 ^ ((1 << width) - 1 << width * i | (1 << width) - 1 << width * j)
        alone = [(0, 0), (1, 0), (2, 0), (0, 1), (0, 2)] if i % 2 == 0 and j == i + 1 else []
        out += [(kept - (kept >> 63 << 64), width * i, width * j, x, y) for x, y in ([(1, 1), (1, -1), *alone] if probes else [(0, 0)])]
    return out


def _placed(fps: DataFrame, segments: int, probes: bool = False) -> DataFrame:
    """(fp, cell): fps(fp) at all their cells. A cell's name is a hash of the bits that it keeps and of its counts."""
    steps = F.array(*[F.struct(*[F.lit(v).cast("bigint" if n == "keep" else "int").alias(n) for n, v in zip(("keep", "i", "j", "x", "y"), s, strict=True)]) for s in _steps(segments, probes)])
    count = lambda at: F.expr(f"bit_count(shiftrightunsigned(fp, at.{at}) & {(1 << 64 // segments) - 1}L)")
    kept, counts = F.col("fp").bitwiseAND(F.col("at.keep")), (count("i") + F.col("at.x"), count("j") + F.col("at.y"))
    return fps.select("fp", F.explode(steps).alias("at")).select("fp", F.xxhash64("at.keep", kept, *counts).alias("cell"))


def _links(fps: DataFrame, grids: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b): pairs of different values of fps(fp) within two bits, enough of them to connect all that are."""
    grids = SEGMENTS if grids is None else grids
    if not grids:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), i)) for i in range(64)])
        shared = fps.select("fp", F.explode(flips).alias("value")).groupBy("value").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        return shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    cells, probes = _placed(fps, grids[0]), _placed(fps, grids[0], probes=True)
    dense = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > DENSE_CELL).select("cell"))
    rest = not dense.isEmpty()
    if rest:  # the two of a pair that would meet in a dense cell are both in `near`
        near = stored(only(cells.unionByName(probes), dense, "cell").select("fp").distinct())
        cells = only(cells, dense, "cell", "left_anti")
    # merged, as sizes are estimated before the rows are copied to their cells, and a broadcast of six times that would be large
    met = probes.withColumnRenamed("fp", "a").join(cells.withColumnRenamed("fp", "b").hint("merge"), "cell").where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH) & (F.col("a") != F.col("b"))).select("a", "b")
    return met.unionByName(_links(near, grids[1:])) if rest else met


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each end of `links(a, b)` the smallest value it is connected to, by alternating stars.

    Each round sends every larger neighbour of a value to the smallest, then every smaller one; the number of rounds
    grows with the logarithm of the longest chain. It raises if `rounds` don't suffice.
    """
    edges, before = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    salts, salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")  # for the centres of large stars
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.select("a", "b", salt).join(least.select("a", "m", salts), ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.where("a <> b"))  # a > b holds
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.select("a", "b", salt).join(low.select("a", "m", salts), ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
        before = now
    raise RuntimeError(f"components: not settled after {rounds} rounds")


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, root) for each row of fps(fp): equal roots where values are connected over links of REACH bits or less."""
    linked = components(_links(fps.select("fp")))
    return fps.join(linked, fps.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of two bits or less).

    One row per input row. Equal texts have equal fingerprints and so one class; the search for links sees each
    fingerprint once. Texts without words, null ones too, have fingerprint zero and link like any other. Rows with a
    null doc_id take part; only a component without any id has a null one. An empty table gives no rows.
    """
    base = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words).select("doc_id", "fp"))
    fps = stored(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = stored(_classes(fps.select("fp")).join(fps, "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return spread_join(base, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rarest(units: DataFrame, similarity: float) -> DataFrame:
    """(unit, n, key): of units(unit, n, few), whose `few` are all shingle hashes of a small set, the rarest ones that occur in more than one unit,
    so many that two sets of the similarity share one of them: any n - ceil(similarity * n) + 1 in an order that is the same for all will do,
    and by frequency, passages that many texts have come last."""
    rows = units.select("unit", "n", F.explode("few").alias("key"))
    often = stored(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").withColumn("often", F.col("times")))
    seen = spread_join(rows, often, "key", "times").groupBy("unit", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("all"))
    # those that no other unit has come first
    wanted = F.size("all") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    return seen.where(wanted > 0).select("unit", "n", F.explode(F.slice("all", F.lit(1), wanted.cast("int"))).alias("one")).select("unit", "n", "one.key")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the different pairs of rows(unit, n, hub, hub_n) whose sizes are within the similarity; a > b."""
    near = F.least("n", "hub_n") >= F.lit(similarity) * F.greatest("n", "hub_n")
    return rows.where((F.col("unit") != F.col("hub")) & near).select(F.greatest("unit", "hub").alias("a"), F.least("unit", "hub").alias("b")).distinct()


def meetings(spread: DataFrame, central: bool = False) -> DataFrame:
    """spread(unit, n, key) with the smallest unit of each key, and its size, as hub and hub_n; keys of one unit go, before anything is joined by a
    shuffle if the others have been counted to be few. central: instead of the smallest unit of a key, the one whose keys have most units. What
    others were copied from shares more keys with them than they do with each other, so it is the hub of most of them, and the same one for each."""
    often = stored(spread.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    several = stored(spread.join(F.broadcast(often), "key") if often.count() <= common.BROADCAST_IDS else spread_join(spread, often.withColumn("_times", F.col("m")), "key", "_times"))
    if central:
        ranked = several.join(several.groupBy("unit").agg((-F.sum("m")).alias("rank")), "unit")
    else:
        ranked = several.withColumn("rank", F.lit(0).cast("bigint"))
    hubs = stored(ranked.groupBy("key").agg(F.min(F.struct("rank", "unit", "n")).alias("best"), F.count("*").alias("m")).select("key", F.col("best.unit").alias("hub"), F.col("best.n").alias("hub_n"), "m"))
    return spread_join(several.drop("m"), hubs, "key", "m")


def first_candidates(units: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of units(unit, n, fp), those that meet the hub of a key, and those whose fingerprints are linked."""
    of_print = stored(units.groupBy("fp").agg(F.min("unit").alias("hub"), F.min_by("n", "unit").alias("hub_n"), F.count("*").alias("m")))
    same = spread_join(units.select("unit", "n", "fp"), of_print.where("m > 1"), "fp", "m")
    linked = of_print.drop("m")
    ends = _links(linked.select("fp")).join(linked.toDF("a", "hub", "hub_n"), "a").join(linked.toDF("b", "unit", "n"), "b")
    columns = ["unit", "n", "hub", "hub_n"]
    return _pairs(met.select(*columns).unionByName(same.select(*columns)).unionByName(ends.select(*columns)), similarity)


def mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, unit, n, root, hub_root, m, with_hub): of met(unit, n, key, hub), the units of keys whose m units are not all connected yet by
    roots(unit, root); hub_root is the root of the key's hub, which with_hub of them have."""
    rooted = stored(met.select("unit", "n", "key", "hub").join(roots, "unit"))
    classes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"), F.max(F.col("unit") == F.col("hub")).alias("of_hub"))
    keys = classes.groupBy("key").agg(F.max_by("root", "of_hub").alias("hub_root"), F.max_by("size", "of_hub").alias("with_hub"), F.sum("size").alias("m"), F.count("*").alias("classes")).where("classes > 1")
    return stored(spread_join(rooted.drop("hub"), stored(keys.select("key", "hub_root", "with_hub", "m", F.col("m").alias("_times"))), "key", "_times"))


def other_candidates(members: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all different pairs of mixed() units of a key that are not connected and can have the similarity by their sizes and by the counts of
    units(unit, counts); a > b. A key's units are dealt to blocks, first those that are not connected with its hub, then the others, which needn't
    meet each other. Each two blocks that have such pairs meet in a task, which holds these only and compares them at once."""
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    apart, apart_blocks, hash_ = F.col("root") != F.col("hub_root"), blocks(F.col("m") - F.col("with_hub")), F.xxhash64("unit", "key")
    at = F.when(apart, F.pmod(hash_, F.col("apart_blocks"))).otherwise(F.col("apart_blocks") + F.pmod(hash_, F.col("hub_blocks"))).cast("int")
    meets = F.when(apart, F.col("apart_blocks") + F.col("hub_blocks")).otherwise(F.col("apart_blocks"))
    dealt = members.withColumns({"apart_blocks": apart_blocks, "hub_blocks": blocks(F.col("with_hub"))}).withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    dealt = dealt.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "unit", "n", "root", (F.col("at") <= F.col("other")).alias("left"), (F.col("at") >= F.col("other")).alias("right"))
    ordered = dealt.join(units.select("unit", "counts"), "unit").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "unit")
    share = (1 - similarity) / (1 + similarity)

    def meet(group: list[pa.Table]) -> pa.RecordBatch | None:
        import numpy as np

        t = pa.concat_tables(group).combine_chunks()
        unit, n, root, left, right = (t[c].to_numpy() for c in ("unit", "n", "root", "left", "right"))
        counts = t["counts"].combine_chunks().flatten().to_numpy().reshape(-1, RANGES).astype(np.int16)
        a, b, of = [], [], np.flatnonzero(right)
        for x in np.flatnonzero(left).tolist():
            near = of[(root[of] != root[x]) & (np.minimum(n[of], n[x]) >= similarity * np.maximum(n[of], n[x]))]
            near = near[np.abs(counts[near] - counts[x]).sum(axis=1, dtype=np.int32) <= share * (n[near] + n[x]) + 1e-6]
            a.append(np.maximum(unit[near], unit[x]))
            b.append(np.minimum(unit[near], unit[x]))
        a, b = np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        group, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(keys[x])
                if group and now != last:
                    yield meet(group)
                    group = []
                group, last = [*group, pa.Table.from_batches([batch.slice(x, y - x)])], now
        if group:
            yield meet(group)

    return ordered.mapInArrow(each, "a bigint, b bigint").distinct()


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are the first of their class, by doc_id with nulls last, then by place in the table.

    Two texts are linked if the sets of their shingles of `words` words have a Jaccard similarity of `similarity` or more, which is verified
    exactly; classes are what links connect. Texts with equal words are one text, texts without words too. Links of up to FEW shingles are found
    by rare shingles, those of longer texts by parts, of which a pair at 0.8 shares none with a probability of 0.007 at most, 0.0005 on average over sizes. A key's texts meet
    one of them, the same for all their keys if it can be; all that are not connected by then meet each other, in blocks that yield those which can be linked, so a key loses no link.
    All columns stay. Of repeated rows one stays. An empty table gives no rows.
    """
    python_ready(docs.sparkSession)

    @F.arrow_udf("struct<digest: string, fp: bigint, n: bigint, counts: array<tinyint>, keys: array<bigint>, few: array<bigint>>")
    def signature(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import xxhash

        names, kinds = ["digest", "fp", "n", "counts", "keys", "few"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for s in parts:
            out = []
            for t in s.to_pylist():
                joined, hashes = shingles(t, words)
                distinct = np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))
                out.append((xxhash.xxh3_128_hexdigest(joined), _majority(hashes), len(distinct), range_counts(distinct).tolist(), part_keys(distinct, similarity), distinct.view(np.int64).tolist() if len(distinct) <= FEW / similarity else []))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    @F.arrow_udf("array<bigint>")
    def sets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for s in parts:
            yield pa.array([np.unique(np.frombuffer(shingles(t, words)[1], ">i8").astype(np.int64)) for t in s.to_pylist()], pa.list_(pa.int64()))

    columns = docs.columns
    base = stored(docs.withColumn("_tessera_row", F.monotonically_increasing_id()).withColumn("_tessera_signature", signature.asNondeterministic()(F.col(text))), "zstd")
    rank = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_tessera_row").alias("row"))
    firsts = base.groupBy(F.col("_tessera_signature.digest").alias("digest")).agg(F.min(rank).alias("best"), F.first("_tessera_signature.fp").alias("fp"), F.first("_tessera_signature.n").alias("n"), F.first("_tessera_signature.counts").alias("counts"))
    units = stored(firsts.select(F.col("best.row").alias("unit"), "best", "fp", F.col("n").cast("int").alias("n"), "counts"))
    whole = only(base.select(F.col("_tessera_row").alias("unit"), "_tessera_signature"), units, "unit").select("unit", F.col("_tessera_signature.n").cast("int").alias("n"), "_tessera_signature.keys", "_tessera_signature.few")

    def similar(pairs: DataFrame) -> DataFrame:
        before = written()
        pairs = stored(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("_tessera_row"))
        of = stored(only(base.select("_tessera_row", F.col(text).alias("_tessera_text")), wanted, "_tessera_row").select(F.col("_tessera_row").alias("unit"), sets.asNondeterministic()(F.col("_tessera_text")).alias("set")))
        both = spread_join(pairs, of.toDF("b", "set_b"), "b").join(of.toDF("a", "set_a"), "a")  # b, the smaller one, may have many
        shared = F.size(F.array_intersect("set_a", "set_b"))
        counted = both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
        links = stored(counted.where(F.col("shared") >= F.lit(similarity) * (F.col("sizes") - F.col("shared")) - F.lit(1e-9)).select("a", "b"))
        discard(docs.sparkSession, before, links)  # the sets, which are as large as the texts
        return links

    spread = whole.select("unit", "n", F.explode("keys").alias("key")).unionByName(rarest(whole, similarity))
    met = stored(meetings(spread, central=True))
    first = components(similar(maybe_similar(stored(first_candidates(units, met, similarity)), units, similarity)))
    roots = stored(units.select("unit").join(first, F.col("unit") == F.col("node"), "left").select("unit", F.coalesce("root", "unit").alias("root")))

    def connected(links: DataFrame) -> DataFrame:
        """`roots` after these links, too."""
        if links.isEmpty():
            return roots
        ends = links.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b")
        more = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).toDF("root", "joined")
        return stored(roots.join(more, "root", "left").select("unit", F.coalesce("joined", "root").alias("root")))

    members = mixed(met, roots)
    if not members.isEmpty():
        roots = connected(similar(other_candidates(members, units, similarity)))
    kept = units.select("unit", "best").join(roots, "unit").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_tessera_row"))
    return only(base, kept, "_tessera_row").select(*columns)

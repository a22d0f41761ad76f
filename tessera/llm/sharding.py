"""Shards of near-equal bytes, tokens and rows by vector bin packing.

Equal texts form a group, whose vector is its bytes, tokens and rows, each as a share of a shard's even part. Groups
are placed in descending order of their greatest share, each where the dot product with the residual capacity is highest among the
shards that it fits in, by bytes alone if in none by all three, or on the emptiest one if in none at all. The greatest go first and the smallest
last, and a few moves between the fullest and the emptiest shard follow, so that the law `bytes` holds: sizes end near equal.

What is packed has a fixed bound, whatever the input: groups of over 1/HEAVY of a shard are items by themselves (there
are 3 * shards * HEAVY at most), all others are dealt by their hash into BUNDLES bundles, which are the items. A group
of over 1/WHOLE of a shard, such as a page that a third of all rows repeat, cannot stay in one shard without breaking the law;
it is dealt into pieces, each an item. So the driver sees that many sums, never rows.

Slots come from counts: rows are dealt within each shard into parts by a stored row number, numbered within their part, and moved
up by the sizes of the parts before.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

BUNDLES = 4096
HEAVY = 128
WHOLE = 4
#: Rows for which a shard gets one more part to number; at least PARTS.
PART_ROWS = 1 << 20
PARTS = 16

Item = tuple[str, float, float, float]


def pack(items: list[Item], shards: int) -> dict[str, int]:
    """Shard by name for (name, bytes, tokens, rows); ties go to the smaller name and the smaller shard."""
    totals = [sum(x[k] for x in items) or 1 for k in (1, 2, 3)]
    left = [[1.0, 1.0, 1.0] for _ in range(shards)]  # residual capacities
    out = {}
    shares = [(name, [s * shards / t for s, t in zip(sizes, totals, strict=True)]) for name, *sizes in items]
    for name, v in sorted(shares, key=lambda x: (-max(x[1]), x[0])):
        fits = [i for i in range(shards) if all(a >= b for a, b in zip(left[i], v, strict=True))] or [i for i in range(shards) if left[i][0] >= v[0]]
        if fits:
            at = max(fits, key=lambda i: (sum(a * b for a, b in zip(v, left[i], strict=True)), -i))
        else:
            at = max(range(shards), key=lambda i: (left[i][0], -i))
        out[name] = at
        left[at] = [a - b for a, b in zip(left[at], v, strict=True)]
    return levelled({name: size for name, size, *_ in items}, out, shards)


def levelled(sizes: dict[str, float], placed: dict[str, int], shards: int, steps: int = 1000, near: float = 0.001) -> dict[str, int]:
    """`placed` after moves and swaps between the fullest and the emptiest shard by bytes, until they are `near` as a
    share of a shard or none brings them closer. It matters for small tables, in which a text is a good part of a shard."""
    names: list[list[tuple[float, str]]] = [[] for _ in range(shards)]
    for name, at in placed.items():
        insort(names[at], (sizes[name], name))
    totals = [sum(b for b, _ in n) for n in names]
    for _ in range(steps):
        full, empty = max(range(shards), key=lambda i: (totals[i], -i)), min(range(shards), key=lambda i: (totals[i], i))
        gap, best = totals[full] - totals[empty], None
        if gap <= near * sum(totals) / shards:
            break
        for b, name in names[full]:
            k = bisect_left(names[empty], (b - gap / 2, ""))
            for back in [(0.0, ""), *names[empty][max(0, k - 1) : k + 1]]:
                rest = abs(gap - 2 * (b - back[0]))
                if rest < gap - 1 and (best is None or rest < best[0]):
                    best = (rest, (b, name), back)
        if best is None:
            break
        _, there, back = best
        for item, a, b in ((there, full, empty), (back, empty, full)):
            if item[1]:
                names[a].remove(item)
                insort(names[b], item)
                totals[a], totals[b] = totals[a] - item[0], totals[b] + item[0]
    return {name: at for at, n in enumerate(names) for _, name in n}


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null), n_tokens: one row per row of `docs`.

    size is the UTF-8 bytes of the text plus 1; a null text has none and counts as a copy of the empty one. Null and
    repeated ids are rows like any other. Tokens are runs of characters other than white space. An empty table gives
    no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"),
            F.regexp_count(t, F.lit(r"\S+")).cast("bigint").alias("n_tokens"), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("row_no"),
        )
    )
    total = base.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("size"), F.coalesce(F.sum("n_tokens"), F.lit(1)).alias("n_tokens"), F.count("*").alias("rows")).first()
    key = ["h", "text_crc32", "size"]
    groups = base.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("n_tokens")).withColumn("bytes", F.col("rows") * F.col("size"))
    share = F.greatest(*[F.col(a) * F.lit(float(shards)) / F.lit(float(max(b, 1))) for a, b in (("bytes", total["size"]), ("n_tokens", total["n_tokens"]), ("rows", total["rows"]))])
    groups = stored(groups.withColumn("share", share))
    bundle = F.concat(F.lit("b"), F.pmod(F.col("h"), F.lit(BUNDLES)).cast("string"))
    light = groups.where(F.col("share") <= 1 / HEAVY).groupBy(bundle.alias("name")).agg(*[F.sum(c).alias(c) for c in ("bytes", "n_tokens", "rows")])
    items = [(r["name"], r["bytes"], r["n_tokens"], r["rows"]) for r in light.collect()]
    spark = docs.sparkSession
    heavy = groups.where(F.col("share") > 1 / HEAVY).select(*key, F.when(F.col("share") > 1 / WHOLE, F.ceil(F.col("share") * HEAVY)).otherwise(1).cast("bigint").alias("pieces"))
    heavy = spark.createDataFrame(heavy.collect(), heavy.schema)  # bounded: 3 * shards * HEAVY rows
    piece = F.pmod(F.xxhash64("row_no"), F.col("pieces")).cast("string")
    name = F.when(F.col("pieces").isNull(), bundle).otherwise(F.concat_ws("|", F.lit("g"), "h", "text_crc32", "size", piece))
    named = base.join(F.broadcast(heavy), key, "left").select("doc_id", "size", "text_crc32", "n_tokens", "row_no", name.alias("name"))
    large = named.where(F.col("name").startswith("g")).groupBy("name").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows"))
    items += [(r["name"], r["bytes"], r["n_tokens"], r["rows"]) for r in large.collect()]  # pieces: shards * HEAVY + groups at most, in each measure
    placed = spark.createDataFrame(list(pack(items, shards).items()), "name string, shard int")
    parts = max(PARTS, total["rows"] // PART_ROWS)
    dealt = named.join(F.broadcast(placed), "name").withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row_no")))
    return within.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens"
    )

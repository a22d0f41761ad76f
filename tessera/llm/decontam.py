"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

An item counts as leaked into a document that holds at least `threshold` of the item's different five-word shingles; an item of fewer
words is one shingle, which the document must hold.
A document that does so misses at most q - ceil(threshold * q) of the item's q shingles, so it holds one of the
q - ceil(threshold * q) + 1 with the smallest hashes, whichever it holds. Items are partitioned by size in powers
of two; a partition's items keep the bottom hashes that its largest size asks for, a MinHash sketch. The largest
hash of any sketch bounds what documents look up, which spares most of their shingles. As the sketch is of the item and the
lookup is in the whole document, a document's length doesn't dilute the search and no link is lost.

All of it is DataFrame functions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, only, spread_join, stored

WORDS = 5
#: Sketch rows up to which they are broadcast: 16 bytes each. More are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Bytes of item texts up to which their shingles are broadcast: a shingle's text is some five times its first word's.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _grams(w: Column, each, size: int) -> Column:
    """each(the words of a shingle) for every run of `size` words of the array `w`; none if there are fewer."""
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: each([F.get(w, i + k) for k in range(size)]))


def _item(w: Column, each) -> Column:
    """The shingles of an item: of WORDS words, or all of its words if there are fewer."""
    out = _grams(w, each, WORDS)
    for size in range(1, WORDS):
        out = F.when(F.size(w) == size, _grams(w, each, size)).otherwise(out)
    return out


def _document(w: Column, each, short: list[int]) -> Column:
    """The shingles of a document: of WORDS words, and of as many as short items have."""
    return F.concat(_grams(w, each, WORDS), *[_grams(w, each, size) for size in short])


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, h): the bottom hashes of each item, as many as its size partition asks for."""
    sized = items.select("item_id", F.array_sort(F.array_distinct(_item(F.col("w"), _hash))).alias("hs")).where(F.size("hs") > 0)
    top = F.pow(F.lit(2), F.ceil(F.log2(F.size("hs")))).cast("int")  # of the partition
    keep = F.least(top - F.ceil(F.lit(threshold) * top).cast("int") + 1, F.size("hs"))
    return sized.select("item_id", F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: the pairs with containment of `threshold` or more.

    docs: doc_id, text; benchmark: item_id, text; other columns don't matter. Words are lower-case runs of letters and
    digits. An item of one to four words has one shingle, the whole sequence, so it leaks into every document that holds these
    words in a row. Null and empty texts match nothing; rows with a null id give nothing. Rows that share an id are
    one document (or item) with the shingles of the row that fits best. Repeated rows add nothing.
    """
    items = stored(benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct())
    bottom = stored(sketches(items, threshold))
    seen = bottom.agg(F.count("*").alias("n"), F.max("h").alias("top")).first()
    of_items = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "w"))).alias("bytes"), F.collect_set(F.when(F.size("w") < WORDS, F.size("w"))).alias("short")).first()  # WORDS - 1 sizes at most
    fits, short = seen["n"] <= BROADCAST_ROWS and (of_items["bytes"] or 0) <= BROADCAST_BYTES, sorted(of_items["short"])
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    top = F.lit(seen["top"] if seen["top"] is not None else -(2**63))
    low = F.filter(let(words(F.col("text")), lambda w: _document(w, _hash, short)), lambda h: h <= top)
    # The outer form of explode: the other one asks for non-empty arrays in a filter that computes them once more. It is apart
    # from the array's projection, so that it joins within generated code, where `text` is a reference until a row has matched.
    probes = named.select("doc_id", "text", low.alias("low")).select("doc_id", "text", F.explode_outer("low").alias("h"))
    if fits:
        found = probes.join(F.broadcast(bottom), "h").groupBy("doc_id", "text").agg(F.collect_set("item_id").alias("items"))
    else:  # shuffled by hash, so without texts; these are joined to what was found
        ids = stored(spread_join(stored(probes.select("doc_id", "h").where("h is not null")), stored(bottom.groupBy("h").agg(F.collect_set("item_id").alias("some"))), "h").select("doc_id", F.explode("some").alias("item_id")).distinct())
        found = named.join(ids.groupBy("doc_id").agg(F.collect_list("item_id").alias("items")), "doc_id")
    texts = items.select("item_id", F.array_distinct(_item(F.col("w"), _text)).alias("of_item"))
    of_doc = F.array_distinct(let(words(F.col("text")), lambda w: _document(w, _text, short)))
    once = found.select("doc_id", of_doc.alias("of_doc"), "items")  # a document's shingles are made once, for all its items
    pairs = once.select("doc_id", "of_doc", F.explode_outer("items").alias("item_id")).join(F.broadcast(texts) if fits else texts, "item_id")
    counted = pairs.select("doc_id", "item_id", F.size(F.array_intersect("of_item", "of_doc")).cast("bigint").alias("n_shared"), F.size("of_item").cast("bigint").alias("n_item"))
    best = counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item")).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_shared").alias("n_shared"), F.col("b.n_item").alias("n_item"), (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; rows with a null doc_id stay."""
    return only(docs, leaks(docs, benchmark, threshold), "doc_id", "left_anti").select(*docs.columns)


LEAKS_SQL = """
WITH t AS (SELECT 'i' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
w AS (SELECT DISTINCT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM t WHERE id IS NOT NULL),
r AS (SELECT row_number() OVER () AS r, side, id, w FROM w WHERE len(w) > 0),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM r WHERE side = 'i'),
u AS (SELECT r, side, id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM r),
l AS (SELECT r, side, id, n, k, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c, lead(x, 3) OVER o AS d, lead(x, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY r ORDER BY k)),
g AS (SELECT r, side, id, n, k, z, concat_ws(' ', a, CASE WHEN z > 1 THEN b END, CASE WHEN z > 2 THEN c END, CASE WHEN z > 3 THEN d END, CASE WHEN z > 4 THEN e END) AS s FROM l JOIN z ON side = 'd' OR z = least(n, 5)),
s AS (SELECT DISTINCT r, side, id, s FROM g WHERE k <= n - z + 1),
n AS (SELECT r, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY r),
p AS (SELECT d.r AS dr, d.id AS doc_id, i.id AS item_id, n_item, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s JOIN n ON n.r = i.r WHERE d.side = 'd' AND i.side = 'i' GROUP BY d.r, i.r, d.id, i.id, n_item HAVING count(*) >= 0.8 * n_item)
SELECT doc_id, item_id, arg_max(n_shared, (n_shared / n_item, n_shared)) AS n_shared, arg_max(n_item, (n_shared / n_item, n_shared)) AS n_item, max(n_shared / n_item) AS containment FROM p GROUP BY doc_id, item_id
"""

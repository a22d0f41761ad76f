"""Which of several filters removes what, alone and in every order, from one histogram per part.

A document's outcomes are a mask: bit i is set if it fails filter i. Whatever the order of the filters, what happens to a document depends
on its mask alone, so a part is summed up by its number of documents of each mask. The histograms of a part - all documents, those of label
good, those of label toxic - are the rows of a matrix of 32 columns; four integer matrices of 32 rows and 600 columns, one for each step of
each of the 120 orders, turn them into what is kept, removed, redundant and unique there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, python_ready, stored

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: White space as the filters see it; what splits words.
SPACE = r"[\x20\x09-\x0D]+"
#: Parts whose rows a task makes at a time.
PARTS_AT_ONCE = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


@cache
def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


@cache
def matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kept, removed, redundant, unique: 1 where a document of the row's mask has that outcome at the column's step."""
    mask = np.arange(MASKS)[:, None]
    at = np.array([[FILTERS.index(c) for c in o] for o in orders()])  # the filter of each step
    before = np.array([[sum(1 << i for i in row[:s]) for s in range(len(row))] for row in at]).ravel()[None, :]
    here = (1 << at).ravel()[None, :]
    fails, gone = (mask & here) > 0, (mask & before) > 0
    return tuple(m.astype(np.int64) for m in (~fails & ~gone, fails & ~gone, fails & gone, np.broadcast_to(mask == here, fails.shape)))


@cache
def by_filter() -> np.ndarray:
    """600 columns to 5: which columns are steps of each filter."""
    return np.array([[c == f for f in FILTERS] for o in orders() for c in o], np.int64)


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A under 200 words; B fewer than half of the words distinct; C over 3 % of the code points
    in A-Z; D any of #$%&*|."""

    def of(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, 1).otherwise(0) + F.when(F.lit(100).cast("bigint") * F.size(F.array_distinct(words)) < F.lit(50).cast("bigint") * n, 2).otherwise(0)

    capitals = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("bigint")
    return (
        let(F.filter(F.split(text, SPACE), lambda w: w != ""), of)
        + F.when(capitals * 100 > F.length(text).cast("bigint") * 3, 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    ).cast("int")


def histograms(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask in each part, and those among them with quality = 1 and with toxic = 1.

    Null texts are empty, null parts the empty string. A document fails E if a smaller doc_id has its text anywhere in the table; rows that
    share a doc_id do not repeat each other, and a null doc_id neither repeats nor is repeated, and has no label. Of several labels of a
    document any 1 counts. Texts are read once and leave as digests (SHA-256); rows that agree in all are summed up before the shuffle, and
    the smallest doc_id of a digest is joined by digest and doc_id, so that no task gets all copies of a text. Neither docs nor labels may be empty
    of columns: docs needs doc_id, text and `part`, labels needs doc_id, quality, toxic; others are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2(text, 256))).alias("digest"), text_mask(text).alias("mask"))
    rows = stored(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where(F.col("doc_id").isNotNull()).join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "n", "good", "toxic")
    every = known.unionByName(rows.where(F.col("doc_id").isNull()).select("part", "mask", "n"), allowMissingColumns=True)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(counts: DataFrame) -> DataFrame:
    """The 600 rows of each part of histograms(): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part has at most 32 rows of counts, which one task multiplies; parts are dealt to tasks. Parts without documents don't occur, so an
    empty table has no rows.
    """
    python_ready(counts.sparkSession)
    cell = F.struct("mask", "n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 at most

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, removed, redundant, unique = matrices()
        names, steps = np.repeat(orders(), len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders()))
        for frame in frames:
            for start in range(0, len(frame), PARTS_AT_ONCE):
                some = frame.iloc[start : start + PARTS_AT_ONCE]
                stack = np.zeros((3, len(some), MASKS), np.int64)  # all, good, toxic
                for i, cells in enumerate(some["cells"]):
                    for c in cells:
                        stack[:, i, c["mask"]] += (c["n"], c["good"], c["toxic"])
                gone = stack @ removed
                shapley = np.take_along_axis(gone[0] @ by_filter(), np.array([[FILTERS.index(c) for o in orders() for c in o]]), axis=1)
                columns = [stack[0] @ kept, gone[0], stack[0] @ redundant, stack[0] @ unique, gone[1], gone[2], shapley]
                yield pd.DataFrame({"part": np.repeat(some["part"].to_numpy(object), len(names)), "filter_order": np.tile(names, len(some)), "step": np.tile(steps, len(some))} | {c: m.ravel() for c, m in zip(COUNTS, columns, strict=True)})

    return parts.mapInPandas(each, RESULT)


#: The same in DuckDB, over the tables documents and labels.
AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
bits AS (
  SELECT doc_id, part, t,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM bits LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS prior FROM orders, range(1, 6) AS r(s)),
cells AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | prior) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & prior > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM cells
"""

"""Cross-entropy difference of a target and a background n-gram model (Moore and Lewis 2010).

Both are character trigram models over one vocabulary and have the same Dirichlet smoothing by their lower orders, and
they are matched in mass: the background's counts, of all its texts, are scaled to the target's total, so neither
looks better for having seen more. A document's score is the mean over its characters of the target's loss less the
background's: the lower, the more it is like the target.

differences() has a vocabulary of all characters, and its models are tables: counts are summed per task, shuffled by
trigram, and joined to the trigrams of blocks of documents, so a task holds what its block has and nothing of the
models is collected or broadcast by this module. train() and score() are for callers that want models of a fixed size
on the driver: they know the VOCABULARY - 2 most frequent characters, and one symbol stands for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_ready, stored

#: Symbols of models of a fixed size. The least size that the smoothing of the open vocabulary assumes.
VOCABULARY = 128
START, OTHER = 0, 1
#: Pseudo-counts that the next lower order gives to each context.
PRIOR = 20.0
CODE_POINTS = 0x110000
#: Of keys of trigrams of code points: bits of each, and the start, which is no code point.
BITS, BEGIN = 21, CODE_POINTS
#: Characters of a block of documents, on average, and rows that a task holds before it passes them on.
BLOCK_CHARS, HELD = 1 << 21, 1 << 20


@dataclass
class Models:
    """symbols: of each code point; target, background: the loss in nats of the last symbol of each trigram."""

    symbols: np.ndarray
    target: np.ndarray
    background: np.ndarray


def trigrams(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths): the trigram that ends at each character, one text after the other, and the texts' lengths."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) for t in texts], np.int64)
    s = symbols[points].astype(np.int64)
    one, two = np.roll(s, 1), np.roll(s, 2)
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    one[first] = two[first] = START
    second = (np.cumsum(lengths) - lengths)[lengths > 1] + 1
    two[second] = START
    return (two * VOCABULARY + one) * VOCABULARY + s, lengths


def _counts(texts: DataFrame, size: int, keys) -> DataFrame:
    """(key, target, background): how often each of the `keys` of the texts comes; texts: text, target (1 or 0)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, size), np.int64)
        for frame in frames:
            for flag in (0, 1):
                part = frame["text"][frame["target"] == flag].tolist()
                if part:
                    found = keys(part)
                    at, n = np.unique(found, return_counts=True)
                    sums[flag][at] += n
        at = np.flatnonzero(sums.any(axis=0))
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pd.DataFrame({"key": k, "target": sums[1][k], "background": sums[0][k]})

    counted = texts.mapInPandas(each, "key bigint, target bigint, background bigint")
    return counted.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def losses(counts: np.ndarray) -> np.ndarray:
    """The loss of each trigram from the (smoothed) counts of all, in natural order."""
    v = VOCABULARY
    three = counts.reshape(v, v, v)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + v)
    p2 = (two + PRIOR * p1) / (two.sum(axis=1, keepdims=True) + PRIOR)
    p3 = (three + PRIOR * p2) / (three.sum(axis=2, keepdims=True) + PRIOR)
    return (-np.log(p3)).reshape(-1).astype(np.float32)


def train(background: DataFrame, target: DataFrame, text: str = "text") -> Models:
    """The models of all texts of two tables. Null texts count as empty; a table without texts gives the uniform model."""
    python_ready(background.sparkSession)
    t = F.coalesce(F.col(text), F.lit("")).alias("text")
    texts = background.select(t, F.lit(0).alias("target")).unionByName(target.select(t, F.lit(1).alias("target")))
    code_points = lambda part: np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = _counts(texts, CODE_POINTS, code_points).orderBy((F.col("target") + F.col("background")).desc(), "key").limit(VOCABULARY - 2).collect()
    symbols = np.full(CODE_POINTS, OTHER, np.uint8)
    for i, r in enumerate(seen):
        symbols[r["key"]] = 2 + i
    known = background.sparkSession.sparkContext.broadcast(symbols)
    rows = _counts(texts, VOCABULARY**3, lambda part: trigrams(part, known.value)[0]).toPandas()  # VOCABULARY ** 3 rows at most
    counts = np.zeros((2, VOCABULARY**3))
    for i, side in enumerate(("target", "background")):
        counts[i][rows["key"].to_numpy(np.int64)] = rows[side].to_numpy(np.float64)
    mass = counts.sum(axis=1)
    if mass.all():
        counts[1] *= mass[0] / mass[1]
    return Models(symbols, losses(counts[0]), losses(counts[1]))


def score(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, target_loss and background_loss (nats a character), and score, the first less the second.

    Null and empty texts have no tokens and zeros. Repeated rows get equal scores; extra columns stay.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("struct<n_tokens: bigint, target_loss: double, background_loss: double>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in parts:
            keys, lengths = trigrams([x or "" for x in s], m.symbols)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            sums = [np.concatenate([[0.0], np.cumsum(table[keys], dtype=np.float64)]) for table in (m.target, m.background)]
            means = [(c[starts[1:]] - c[starts[:-1]]) / np.maximum(lengths, 1) for c in sums]
            yield pd.DataFrame({"n_tokens": lengths, "target_loss": means[0], "background_loss": means[1]})

    out = docs.withColumn("_tessera_lm", each.asNondeterministic()(F.col(text)))
    return out.withColumns({k: F.col(f"_tessera_lm.{k}") for k in ("n_tokens", "target_loss", "background_loss")}).withColumn("score", F.col("target_loss") - F.col("background_loss")).drop("_tessera_lm")


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths): as trigrams() has them, of code points."""
    lengths = np.array([len(t) for t in texts], np.int64)
    s = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    one, two = np.roll(s, 1), np.roll(s, 2)
    starts = np.cumsum(lengths) - lengths
    first, second = starts[lengths > 0], starts[lengths > 1] + 1
    one[first] = two[first] = two[second] = BEGIN
    return two << 2 * BITS | one << BITS | s, lengths


def _trigram_counts(texts: DataFrame) -> DataFrame:
    """(key, target, background): how often each trigram comes in all texts; texts: text, target (1 or 0)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat(parts).groupby("key", as_index=False).sum()

        held, n = [], 0
        for frame in frames:
            for flag in (0, 1):
                found, times = np.unique(keys(frame["text"][frame["target"] == flag].tolist())[0], return_counts=True)
                held.append(pd.DataFrame({"key": found, "target": times * flag, "background": times * (1 - flag)}))
                n += len(found)
            if n > HELD:
                held = [summed(held)]
                n = len(held[0])
                if n > HELD // 2:
                    yield held[0]
                    held, n = [], 0
        if held:
            yield summed(held)

    counted = texts.mapInPandas(each, "key bigint, target bigint, background bigint")
    return counted.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _losses(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, target, background): both models' losses in nats of the last symbol of each trigram of wanted(key).

    The trigrams that `counts` lacks have a count of zero. A model without counts is uniform.
    """
    sides = ("target", "background")
    low = (1 << BITS) - 1
    x, y, z = F.shiftright("key", 2 * BITS), F.shiftright("key", BITS).bitwiseAND(F.lit(low)), F.col("key").bitwiseAND(F.lit(low))
    first_two, last_two = F.shiftright("key", BITS), F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1))

    def total(name: str, of: DataFrame, by) -> DataFrame:
        return of.groupBy(by.alias(name)).agg(*[F.sum(side).alias(f"{name}_{side}") for side in sides])

    one = stored(total("one", counts, z))
    mass = one.agg(*[F.coalesce(F.sum(f"one_{side}"), F.lit(0)).alias(side) for side in sides], F.count("*").alias("symbols")).first()
    size = max(VOCABULARY, mass["symbols"] + 2)
    scale = {"target": 1.0, "background": mass["target"] / mass["background"] if mass["target"] and mass["background"] else 1.0}
    n = lambda name, side: F.coalesce(F.col(f"{name}_{side}") * F.lit(scale[side]), F.lit(0.0))
    two = stored(total("two", counts, last_two))
    before = two.select(F.shiftright("two", BITS).alias("key"), *[F.col(f"two_{side}").alias(side) for side in sides])
    pairs = wanted.select(last_two.alias("pair")).distinct().withColumns({"one": F.col("pair").bitwiseAND(F.lit(low)), "ctx1": F.shiftright("pair", BITS)})
    pairs = pairs.join(two, F.col("pair") == F.col("two"), "left").join(one, "one", "left").join(total("ctx1", before, F.col("key")), "ctx1", "left")
    p1 = {side: (n("one", side) + 1) / F.lit(mass[side] * scale[side] + size) for side in sides}
    pairs = pairs.select("pair", *[((n("two", side) + PRIOR * p1[side]) / (n("ctx1", side) + PRIOR)).alias(f"p2_{side}") for side in sides])
    three = counts.select(F.col("key"), *[F.col(side).alias(f"three_{side}") for side in sides])
    rows = wanted.select("key", first_two.alias("ctx2"), last_two.alias("pair")).join(three, "key", "left").join(pairs, "pair").join(total("ctx2", counts, first_two), "ctx2", "left")
    return rows.select("key", *[(-F.log((n("three", side) + PRIOR * F.col(f"p2_{side}")) / (n("ctx2", side) + PRIOR))).alias(side) for side in sides])


def differences(docs: DataFrame, background: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, target_loss, background_loss and score, as score() has them, by models of all characters of
    two tables.

    Every distinct character is a symbol and every trigram has its counts, whatever the input.
    """
    python_ready(docs.sparkSession)
    full = F.coalesce(F.col(text), F.lit(""))
    texts = background.select(full.alias("text"), F.lit(0).alias("target")).unionByName(target.select(full.alias("text"), F.lit(1).alias("target")))
    counts = stored(_trigram_counts(texts))
    columns = [c for c in docs.columns if c not in ("n_tokens", "target_loss", "background_loss", "score")]
    rows = stored(docs.select(*columns).withColumn("_tessera_row", F.monotonically_increasing_id()))
    mean = rows.agg(F.avg(F.length(full))).first()[0] or 0.0
    length = max(1, int(BLOCK_CHARS / max(mean, 1.0)))  # rows of a block; a row's number holds its partition in the high bits
    at = F.col("_tessera_row")
    block = (at - F.pmod(at.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(length))).alias("block")
    parts = rows.select(block, at.alias("row"), full.alias("text"))

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, now = [], 0, None
        for frame in frames:
            for b, part in frame.groupby("block", sort=False):
                if held and b != now:
                    yield pd.DataFrame({"block": now, "key": np.unique(np.concatenate(held))})
                    held, n = [], 0
                now = b
                held.append(np.unique(keys(part["text"].tolist())[0]))
                n += len(held[-1])
                if n > HELD:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
        if held:
            yield pd.DataFrame({"block": now, "key": np.unique(np.concatenate(held))})

    asked = stored(parts.select("block", "text").mapInPandas(distinct, "block bigint, key bigint"))
    losses = stored(_losses(asked.select("key").distinct(), counts))

    def each(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("key")
        find, tables = known["key"].to_numpy(), [known[side].to_numpy() for side in ("target", "background")]
        out, lengths = [], texts["text"].str.len().to_numpy(np.int64)
        groups = np.cumsum(lengths) // (1 << 20)
        for _, part in texts.groupby(groups):
            found, n = keys(part["text"].tolist())
            place, starts = np.searchsorted(find, found), np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[0.0], np.cumsum(t[place])]) for t in tables]
            means = [(c[starts[1:]] - c[starts[:-1]]) / np.maximum(n, 1) for c in sums]
            out.append(pd.DataFrame({"row": part["row"], "n_tokens": n, "target_loss": means[0], "background_loss": means[1]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "n_tokens": [], "target_loss": [], "background_loss": []})

    with_losses = asked.join(losses, "key")
    scored = parts.groupBy("block").cogroup(with_losses.groupBy("block")).applyInPandas(each, "row bigint, n_tokens bigint, target_loss double, background_loss double")
    out = rows.join(scored.withColumnRenamed("row", "_tessera_row"), "_tessera_row").drop("_tessera_row")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))

"""Quality by naive Bayes support vectors.

A text's features are indicators of its hashed character n-grams, case and punctuation included, and of n-grams of the
sequences that say of each word, and of each line, whether it repeats the one before or, for lines, any before. Each indicator is
scaled by its class log-count ratio (Wang and Manning 2012), a text's features are brought to length one, and a linear hinge-loss
model is fitted by dual coordinate descent (Hsieh et al. 2008). Margins become probabilities by Platt's method, on a
part of the sample that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, python_ready
from tessera.llm.features import codes, ngram_hashes, platt, sigmoid

BUCKETS = 1 << 17
SHORTEST, LONGEST = 1, 4
#: Repeats of words and of lines are counted up to this.
LONGEST_RUN = 6
#: Rows of labelled documents that the model is fitted on, half of each label.
SAMPLE_ROWS = 4_000


def _runs(repeats: list[bool]) -> int:
    """The length of the longest run of repeats: an n-gram of n repeats is in a sequence if that is n or more."""
    return max(map(len, "".join("x" if r else " " for r in repeats).split()), default=0)


def indicators(text: str, seen: np.ndarray) -> np.ndarray:
    """The buckets of the n-grams in a text, ascending. `seen`: a false array of BUCKETS, which is left so."""
    w, before = text.split(), set()
    lines = [line in before or before.add(line) is not None for line in text.split("\n") if line.strip()]
    for at, n in ((0, _runs(list(map(eq, w, w[1:])))), (LONGEST_RUN, _runs(lines)), (2 * LONGEST_RUN, sum(lines))):
        seen[at : at + min(n, LONGEST_RUN)] = True
    points = codes(text)
    for h in ngram_hashes(points, SHORTEST, LONGEST, BUCKETS):
        seen[h] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """The weights of the linear model of least hinge loss (L1-loss, L2-regularised) by dual coordinate descent; y: 1 or -1."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in values])
    random = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(rows)):
            if norms[i] == 0:
                continue
            gradient = y[i] * float(values[i] @ w[rows[i]]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3 * cost:
            break
    return w


@dataclass
class Model:
    """weights: of each bucket, its log-count ratio included; a, b: of the probability."""

    weights: np.ndarray
    ratios: np.ndarray
    a: float
    b: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return 0.0
        length = float(np.sqrt((self.ratios[found].astype(np.float64) ** 2).sum())) or 1.0
        return float(self.weights[found].sum(dtype=np.float64)) / length


def train(sample: list[tuple[str, int]], shift: float = 0.0) -> Model:
    """From (text, 0 or 1); every fifth row calibrates. shift: log-odds of label 1 in the population less those of the sample."""
    order = np.random.default_rng(1).permutation(len(sample))
    seen = np.zeros(BUCKETS, bool)
    y = np.array([sample[i][1] for i in order], np.int64)
    found = [indicators(sample[i][0], seen) for i in order]
    fit = np.arange(len(order)) % 5 != 0
    if len(set(y[fit].tolist())) < 2:
        flat = np.zeros(BUCKETS, np.float32)
        return Model(flat, flat, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) + shift)
    counts = np.ones((2, BUCKETS))
    for i in np.flatnonzero(fit):
        counts[y[i]][found[i]] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratios = ratios.astype(np.float32)
    values = [(lambda v: v / (np.sqrt(float(v @ v)) or 1.0))(ratios[f].astype(np.float64)) for f in found]
    at = np.flatnonzero(fit)
    w = descend([found[i] for i in at], [values[i] for i in at], np.where(y[at] > 0, 1.0, -1.0), BUCKETS)
    model = Model((w * ratios).astype(np.float32), ratios, 1.0, 0.0)
    rest = np.flatnonzero(~fit) if (~fit).any() else at
    model.a, model.b = platt(np.array([model.margin(found[i]) for i in rest]), y[rest], shift)
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on), in place of columns of these names.

    The model is fitted on at most `rows` labelled documents that are not held out (crc32 of doc_id mod 5 is not 0); every text is
    scored whole. Null texts count as empty; a text without n-grams gets the probability of margin zero. With no or
    one label, all scores are that label's smoothed share. Repeated rows get equal scores.
    """
    sample, shift = labelled_sample(docs.select("doc_id", F.col(text).alias("text")), labels, label, rows)
    model = docs.sparkSession.sparkContext.broadcast(train(sample, shift))
    python_ready(docs.sparkSession)

    @F.pandas_udf("double")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, seen = model.value, np.zeros(BUCKETS, bool)
        for s in parts:
            yield pd.Series(sigmoid(m.a * np.array([m.margin(indicators(t or "", seen)) for t in s], float) + m.b))

    return docs.withColumn("score", each.asNondeterministic()(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

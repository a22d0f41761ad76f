"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, borders included, so that a misspelling shares most of its
vectors with the word it hides. A window is the sum of its different words over its length, and a linear softmax over it gives the
class (Joulin et al. 2016). Vectors and softmax are trained together by Adam over the windows of labelled texts,
each with its text's label. Passages of toxic texts that are clean look like those of clean texts, so they cancel out.

A text's margin is the sum of those of its most toxic window of each of three lengths, each over its spread: the short one finds an insult
in a long text, the long one many that are far apart. These windows overlap by half, so what is found doesn't depend on where a text begins.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, python_ready
from tessera.llm.features import codes, ngram_hashes, platt, sigmoid

BUCKETS, DIMENSIONS = 1 << 16, 4
SHORTEST, LONGEST = 3, 9
#: Words of a window in training, and of the windows that texts are scored by.
WINDOW, SPANS = 32, (8, 64, 512)
#: Rows of labelled documents that the model is fitted on, half of each label.
SAMPLE_ROWS = 2_400
#: The decay keeps vectors of n-grams that few windows have near zero.
STEPS, RATE, DECAY = 50, 0.05, 4e-5
#: Of a window's mean, so that a single word of it can tell.
SCALE = 16.0
#: Words that a worker remembers.
MEMORY = 20_000

words = re.compile(r"\w+").findall


def _subwords(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) + 2 for w in of])
    points = codes("".join(f"<{w}>" for w in of))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(of), dtype=np.int32), lengths)
    hashes, owners = [], []
    for n, h in zip(range(SHORTEST, LONGEST + 1), ngram_hashes(points, SHORTEST, LONGEST, BUCKETS), strict=False):
        inside = np.arange(len(h)) + n <= ends[: len(h)]
        hashes.append(h[inside].astype(np.int32))
        owners.append(owner[: len(h)][inside])
    o, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(o, kind="stable")
    return h[order], np.bincount(o, minlength=len(of))


def subwords(of: list[str], at_once: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the n-grams of <word> for each of some words, one after the other; no word is without one."""
    parts = [_subwords(of[i : i + at_once]) for i in range(0, len(of), at_once)]
    counts = np.concatenate([n for _, n in parts])
    return np.concatenate([h for h, _ in parts]), np.cumsum(counts) - counts


@dataclass
class Model:
    """gains: what each n-gram's vector adds to the log-odds of class 1; a, b: of the probability; spreads: of the margins of each span."""

    gains: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    spreads: tuple[float, ...] = (1.0,) * len(SPANS)
    known: dict[str, float] = field(default_factory=dict)

    def learn_words(self, texts: list[list[str]]) -> None:
        """Fills `known` with all words of some texts."""
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [*{w for t in texts for w in t if w not in self.known}]
        if new:
            h, starts = subwords(new)
            sums = np.add.reduceat(self.gains[h], starts) / np.diff([*starts, len(h)])
            self.known.update(zip(new, sums.tolist(), strict=True))

    def spans(self, texts: list[str]) -> np.ndarray:
        """Of each text: the log-odds of its most toxic window of each length; without words, the bias."""
        split = [words(t.lower()) for t in texts]
        self.learn_words(split)
        out = np.full((len(texts), len(SPANS)), self.bias)
        for i, t in enumerate(split):
            if t:
                values = np.array([self.known[w] for w in t])
                for j, size in enumerate(SPANS):
                    step = size // 2
                    n = max(1, -(-(len(t) - size) // step) + 1)  # windows, the last one filled up
                    v = np.zeros((n - 1) * step + size)
                    v[: len(t)] = values
                    v = np.sort(np.lib.stride_tricks.sliding_window_view(v, size)[::step], axis=1)
                    v[:, 1:][v[:, 1:] == v[:, :-1]] = 0  # a word counts once in a window
                    out[i, j] = v.sum(1).max() / size + self.bias
        return out

    def margins(self, texts: list[str]) -> np.ndarray:
        return (self.spans(texts) / self.spreads).sum(axis=1)


def _adam(parameters: list[np.ndarray]):
    m, v, t = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0

    def step(gradients: list[np.ndarray]) -> None:
        nonlocal t
        t += 1
        for p, g, a, b in zip(parameters, gradients, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    return step


def _sums(of: np.ndarray, at: np.ndarray, size: int):
    """A function that adds the rows `of` of a table up at the places `at`."""
    order = np.argsort(at, kind="stable")
    there, starts = np.unique(at[order], return_index=True)
    of = of[order]

    def sums(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((size, rows.shape[1]), np.float32)
        out[there] = np.add.reduceat(rows[of], starts, axis=0)
        return out

    return sums


def train(sample: list[tuple[str, int]], shift: float = 0.0) -> Model:
    """From (text, 0 or 1); every fifth row calibrates. shift: log-odds of label 1 in the population less those of the sample."""
    y = np.array([label for _, label in sample], np.int64)
    order = np.random.default_rng(1).permutation(len(sample))
    fit, rest = order[np.arange(len(order)) % 5 != 0], order[::5]
    if len(set(y[fit].tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) + shift)
    number: dict[str, int] = {}
    flat, starts, owner = [], [], []
    for i in fit.tolist():
        t = [number.setdefault(w, len(number)) for w in words(sample[i][0].lower())]
        for k in range(0, len(t), WINDOW):
            starts.append(len(flat))
            owner.append(i)
            flat += dict.fromkeys(t[k : k + WINDOW])
    flat, starts, owner = np.array(flat, np.int64), np.array(starts, np.int64), np.array(owner, np.int64)
    h, first = subwords([*number])
    per_word = np.diff([*first, len(h)])
    word_of, window_of = np.repeat(np.arange(len(number)), per_word), np.repeat(np.arange(len(starts)), np.diff([*starts, len(flat)]))
    to_words, to_vectors, share = _sums(window_of, flat, len(number)), _sums(word_of, h, BUCKETS), (1 / per_word).astype(np.float32)[:, None]
    target, toxic = np.eye(2, dtype=np.float32)[y[owner]], y[owner] > 0
    weight = np.where(toxic, 0.25 / max(toxic.sum(), 1), 0.75 / max((~toxic).sum(), 1)).astype(np.float32)
    random = np.random.default_rng(0)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    classes, bias = random.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    step = _adam([vectors, classes, bias])
    for _ in range(STEPS):
        of_word = np.add.reduceat(vectors[h], first, axis=0) * share
        of_window = np.add.reduceat(of_word[flat], starts, axis=0) * np.float32(SCALE / WINDOW)
        logits = of_window @ classes + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (p - target) * weight[:, None]
        back = wrong @ classes.T * np.float32(SCALE / WINDOW)
        to_word = to_words(back) * share
        step([to_vectors(to_word) + DECAY * vectors, of_window.T @ wrong + DECAY * classes, wrong.sum(0)])
    model = Model((SCALE * vectors @ (classes[:, 1] - classes[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    rest = rest if len(set(y[rest].tolist())) == 2 else order
    found = model.spans([sample[i][0] for i in rest])
    model.spreads = tuple(float(x) or 1.0 for x in found.std(axis=0))
    model.a, model.b = platt((found / model.spreads).sum(axis=1), y[rest], shift)
    model.known.clear()
    return model


def fitted(spark: SparkSession, sample: list[tuple[str, int]], shift: float = 0.0) -> Model:
    """train() in a task, as it takes hundreds of MB, which the driver would keep."""
    python_ready(spark)
    given = spark.sparkContext.broadcast(sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(given.value, shift))], pa.binary())], ["model"])

    model = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(each, "model binary").first()["model"])
    given.destroy()
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on), in place of columns of these names.

    The model is fitted on at most `rows` labelled documents that are not held out (crc32 of doc_id mod 5 is not 0); every text is
    scored whole. Null texts count as empty; a text without words gets the probability of a window without words.
    With no or one label, all scores are that label's smoothed share. Repeated rows get equal scores.
    """
    sample, shift = labelled_sample(docs.select("doc_id", F.col(text).alias("text")), labels, label, rows)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, sample, shift))

    @F.arrow_udf("double")
    def each(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for s in parts:
            yield pa.array(sigmoid(m.a * m.margins([t or "" for t in s.to_pylist()]) + m.b), pa.float64())

    return docs.withColumn("score", each.asNondeterministic()(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` scored below `threshold`, with the columns of `docs`, one named score or predicted too."""
    own = {c: f"_tessera_{c}" for c in ("score", "predicted") if c in docs.columns}
    scored = score(docs.withColumnsRenamed(own), labels, threshold=threshold, text=text).where(F.col("score") < threshold)
    return scored.drop("score", "predicted").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)

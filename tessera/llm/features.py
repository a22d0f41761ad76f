"""Hashed character n-grams and probability calibration, in numpy."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """The code points of a text as 64-bit integers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def ngram_hashes(points: np.ndarray, shortest: int, longest: int, buckets: int) -> list[np.ndarray]:
    """For each length, the bucket of the n-gram that starts at each place. buckets: a power of two."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    h, out = np.zeros(len(points), np.uint64), []
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(1)) * MULTIPLIER
        h ^= h >> np.uint64(29)
        if n >= shortest:
            out.append(((h * MULTIPLIER) >> shift).astype(np.int64))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def platt(margins: np.ndarray, y: np.ndarray, shift: float = 0.0) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) fits the labels, by Newton steps on smoothed targets (Platt 1999).

    shift: log-odds of label 1 in the population less those of the sample, by which its rows are weighted.
    """
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not len(y):
        return 1.0, shift
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, np.exp(min(shift, 0.0)), np.exp(min(-shift, 0.0)))
    scale = float(np.std(margins)) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], 1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1)) + shift])
    for _ in range(200):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - target)) + 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])

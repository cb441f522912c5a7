"""Hashed character n-grams and a small logistic regression, in NumPy."""

from __future__ import annotations

import numpy as np

BITS = 18
BINS = 1 << BITS


def ngram_bins(text: str | None, orders: tuple[int, ...]) -> list[np.ndarray]:
    """For each order, the hash bin of every character n-gram of the lower-cased text; shorter texts have none."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, gram, have = [], codes, 1
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(1)
        if n in orders and len(gram):
            h = (gram ^ (gram >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * n) | 1)
            out.append(h >> np.uint32(32 - BITS))
    return out


def counted(bins: list[np.ndarray], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct bins, log(1 + how often each occurs)), of those marked in `used` where given."""
    if used is not None:
        bins = [b[used[b]] for b in bins]
    if not bins:
        return np.zeros(0, np.uint32), np.zeros(0)
    b, n = np.unique(np.concatenate(bins), return_counts=True)
    return b, np.log1p(n)


def tell_apart(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, most: int, least_z: float) -> tuple[np.ndarray, np.ndarray]:
    """(the `most` bins that tell class 1 from class 0 best, log-count ratio of every bin), of counted texts.

    A bin tells by its ratio over what chance does to it, and at least by `least_z`.
    """
    total, having = np.ones((2, BINS)), np.ones((2, BINS))
    for (bins, value), c in zip(texts, y.astype(int)):
        total[c, bins] += value
        having[c, bins] += 1
    share = total / total.sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    z = np.abs(ratio) / np.sqrt(1 / having[0] + 1 / having[1])
    chosen = np.sort(np.argsort(-z, kind="stable")[:most])
    return chosen[z[chosen] >= least_z], ratio


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 200, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the mean (weighted) loss with l2 / (2 n) |w|^2."""
    n, m = x.shape
    s = np.ones(n) if weight is None else weight / weight.mean()
    s = s.astype(x.dtype)  # products stay in x's precision
    v = np.ones(m, x.dtype) / np.sqrt(m).astype(x.dtype)
    for _ in range(15):
        v = x.T @ (s * (x @ v))
        v /= np.linalg.norm(v) + x.dtype.type(1e-12)
    top = float((s * (x @ v) ** 2).sum()) + float(s.sum())  # bounds the matrix with its column of ones, twice over
    rate = 1 / (0.5 * top / n + l2 / n + 1e-9)
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        e = (s * (sigmoid(x @ z[:-1].astype(x.dtype) + z[-1]) - y)).astype(x.dtype)
        g = np.r_[x.T @ e + l2 * z[:-1], e.sum()] / n
        new, t2 = z - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])

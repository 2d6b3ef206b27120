"""Logistic regression over hashed n-grams, fitted with per-coordinate steps and an L1 term (FTRL-proximal)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from doclens.llm import features as T


class Grams(NamedTuple):
    """What a model reads of a text. Each order of n-gram is summed on its own and divided by its number to `norm`."""

    bits: int = 18
    chars: tuple[int, ...] = (4,)
    words: tuple[int, ...] = (1,)
    #: 0: sums; 0.5: sums by the root of their number; 1: means.
    norm: float = 0.5
    lower: bool = True
    #: A word is a run of letters and digits; else of anything but ASCII white space.
    wordy: bool = True


def positions(g: Grams, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram of the texts in turn, and of each text the first of its n-grams."""
    raw = T.LOWER[data] if g.lower else data
    values = raw.astype(np.uint64) + np.uint64(1)
    mask, out = np.uint64((1 << g.bits) - 1), []
    for n in g.chars:
        h = (T.gram_hashes(values, n) & mask).astype(np.int32)
        keep = np.ones(len(h), bool)
        for k in range(1, n):  # those that reach into the next text
            cut = offsets[1:-1] - k
            keep[cut[(cut >= 0) & (cut < len(h))]] = False
        first = np.zeros(len(h) + 1, np.int64)
        np.cumsum(keep, out=first[1:])
        out.append((h[keep], first[np.minimum(offsets, len(h))]))
    if g.words:
        spans = T.runs(T.WORDY[raw] if g.wordy else ~T.SPACE[raw], offsets)
        word = T.span_hashes(T.prefix_sums(values), spans.starts, spans.ends)
        for n in g.words:
            h = T.gram_hashes(word, n)
            keep = np.ones(len(h), bool)
            for k in range(1, n):
                cut = spans.first[1:-1] - k
                keep[cut[(cut >= 0) & (cut < len(h))]] = False
            first = np.zeros(len(h) + 1, np.int64)
            np.cumsum(keep, out=first[1:])
            out.append(((h[keep] & mask).astype(np.int32), first[np.minimum(spans.first, len(h))]))
    return out


def weighted(g: Grams, grams: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """The weights' sums for each text."""
    total = 0.0
    for h, first in grams:
        n = np.diff(first)
        sums, full = np.zeros(len(n)), np.flatnonzero(n)
        if len(full):  # each text by itself, whatever stands beside it
            sums[full] = np.add.reduceat(weights[h].astype(np.float64), first[full])
        total = total + sums / np.maximum(n, 1) ** g.norm
    return total


def rows(g: Grams, grams: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text: what weighted() multiplies."""
    out = []
    for k in range(len(grams[0][1]) - 1):
        at = [(h[first[k] : first[k + 1]], float(max(1, first[k + 1] - first[k])) ** -g.norm) for h, first in grams]
        ids, back = np.unique(np.concatenate([h for h, _ in at]), return_inverse=True)
        out.append((ids, np.bincount(back, np.concatenate([np.full(len(h), v) for h, v in at]), len(ids)).astype(np.float32)))
    return out


def sparse_batch(g: Grams, batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    """keep's columns with each row's buckets and values as bytes."""
    found = rows(g, positions(g, *T.text_buffers(batch.column("text"))))
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in keep), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
        [*keep, "ids", "vals"],
    )


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, dense: np.ndarray | None = None, epochs: int = 4,
        rate: float = 0.1, l1: float = 0.02, l2: float = 1.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the buckets, weights of 1 and the dense columns). Classes count alike in all."""
    extra = np.ones((len(y), 1)) if dense is None else np.column_stack([np.ones(len(y)), dense])
    z, n = np.zeros(dim), np.zeros(dim)
    wd, nd = np.zeros(extra.shape[1]), np.ones(extra.shape[1])
    share = max(1e-9, y.mean()) if len(y) else 0.5
    weigh = np.where(y == 1, 0.5 / share, 0.5 / max(1e-9, 1 - share))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(y)):
            ids, v = x[k]
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((1.0 + np.sqrt(ni)) / rate + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ v + wd @ extra[k], -30, 30)))
            e = (p - y[k]) * weigh[k]
            grad = e * v
            root = np.sqrt(ni + grad * grad)
            z[ids] = zi + grad - (root - np.sqrt(ni)) / rate * w
            n[ids] = ni + grad * grad
            g = e * extra[k]
            nd += g * g
            wd -= rate * g / np.sqrt(nd)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((1.0 + np.sqrt(n)) / rate + l2))
    return w.astype(np.float32), wd


def predict(x: list[tuple[np.ndarray, np.ndarray]], model: tuple[np.ndarray, np.ndarray], dense: np.ndarray | None = None) -> np.ndarray:
    """The log-odds of each row."""
    w, wd = model
    extra = np.ones((len(x), 1)) if dense is None else np.column_stack([np.ones(len(x)), dense])
    return np.array([w[i] @ v for i, v in x]) + extra @ wd if x else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """A fold for each id, by its hash."""
    return (T.mix(ids.astype(np.uint64)) % np.uint64(k)).astype(int)


def out_of_fold(x: list, y: np.ndarray, fold: np.ndarray, dim: int, dense: np.ndarray | None = None, **how) -> np.ndarray:
    """Log-odds of each row from a model that hasn't seen its fold."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        part = lambda rows: None if dense is None else dense[rows]
        out[inside] = predict([x[i] for i in inside], fit([x[i] for i in outside], y[outside], dim, part(outside), **how), part(inside))
    return out


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is the share of ones among rows with such a score (Newton's steps)."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, c = np.column_stack([score, np.ones(len(score))]), np.array([1.0, 0.0])
    for _ in range(rounds if len(y) else 0):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        c -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])

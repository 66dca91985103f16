"""Hashed n-gram features of text batches, and sparse linear models fitted on bounded samples."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def is_letter() -> np.ndarray:
    """For each code point of the basic plane; what lies beyond counts as letters by ``letters``."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


@cache
def is_letter_or_digit() -> np.ndarray:
    return np.array([chr(c).isalpha() or chr(c).isdigit() for c in range(0x10000)])


def _looked_up(codes: np.ndarray, table: np.ndarray, beyond) -> np.ndarray:
    high = codes >= len(table)
    if not high.any():
        return table[codes]
    out = table[np.where(high, 0, codes)]
    out[high] = [beyond(chr(c)) for c in codes[high]]
    return out


def letters(codes: np.ndarray) -> np.ndarray:
    return _looked_up(codes, is_letter(), str.isalpha)


def letters_and_digits(codes: np.ndarray) -> np.ndarray:
    return _looked_up(codes, is_letter_or_digit(), lambda c: c.isalpha() or c.isdigit())


def code_points(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, offsets)`` of a text column; a null is an empty text."""
    texts = [t or "" for t in column.to_pylist()]
    if lower:
        texts = [t.lower() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    # lone surrogates can't be in Arrow strings
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets


def gram_buckets(codes: np.ndarray, offsets: np.ndarray, n: int, bits: int, seed: int = 0) -> np.ndarray:
    """Bucket of the ``n`` values from each place on; ``1 << bits`` where they leave their row."""
    size = len(codes)
    out = np.full(size, 1 << bits, dtype=np.int32)
    if size < n:
        return out
    value = np.full(size - n + 1, seed + n, dtype=np.uint64)
    for k in range(n):
        value = (value + codes[k : size - n + 1 + k]) * _MULTIPLIER
        value ^= value >> np.uint64(31)
    out[: size - n + 1] = ((value * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int32)
    for k in range(1, n):
        ends = offsets[1:] - k
        out[ends[ends >= offsets[:-1]]] = 1 << bits
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` of each row, 0.0 for rows without any."""
    out = np.zeros(len(offsets) - 1)
    filled = offsets[1:] > offsets[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(values, offsets[:-1][filled], dtype=np.float64)
    return out


def sparse_rows(buckets: list[np.ndarray], offsets: list[np.ndarray], bits: int):
    """``(indices, counts)`` of the buckets of each row, over several kinds of grams."""
    counts = np.zeros((1 << bits) + 1, dtype=np.int64)
    for row in range(len(offsets[0]) - 1):
        seen = np.concatenate([b[o[row] : o[row + 1]] for b, o in zip(buckets, offsets)])
        np.add.at(counts, seen, 1)
        counts[-1] = 0
        index = np.flatnonzero(counts)
        yield index.astype(np.int32), counts[index]
        counts[index] = 0


class Ftrl:
    """Follow the regularised leader with elastic net; one column of weights for each class.

    Weights are not kept: they follow from the sums ``z`` of gradients and ``n`` of their squares.
    """

    def __init__(self, size: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, index: np.ndarray, values: np.ndarray, target: np.ndarray) -> None:
        """One example: its features with a last one that is always 1, and the wanted probabilities."""
        w = self.weights(index)
        gradient = np.outer(values, softmax(values @ w) - target)
        n = self.n[index]
        grown = n + gradient**2
        self.z[index] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[index] = grown


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    size: int,
    classes: int,
    epochs: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.001,
    l2: float = 0.001,
    seed: int = 7,
) -> np.ndarray:
    """Weights ``(size + 1, classes)``, the last row being the bias."""
    model = Ftrl(size, classes, alpha, beta, l1, l2)
    wanted = np.eye(classes)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in rng.permutation(len(rows)):
            index, values = rows[at]
            model.step(np.append(index, size), np.append(values, 1.0), wanted[targets[at]])
    return model.weights()


def fitted_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature under which the logits give the targets the highest likelihood."""
    if not len(targets):
        return 1.0
    choices = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-np.log(softmax(logits / t)[np.arange(len(targets)), targets] + 1e-12).mean() for t in choices]
    return float(choices[int(np.argmin(losses))])

"""Quality rules: counted base rules and a hashed n-gram regression (operator 7).

Two heads are fitted on a bounded sample of the labelled rows.  The quality head sees the shares of
hashed character n-grams, words and word pairs, so a long text counts like a short one.  The
toxicity head sees which words and word beginnings occur at all, since a few words in a long text
decide there.  Both are made probabilities by a logistic curve fitted on labelled rows that the
regression did not see.  A text is kept when no base rule fails and both pass fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import (
    byte_codes,
    gram_hashes,
    mixed,
    slices,
    text_bytes,
    word_hashes,
    word_spans,
)
from vacancylake.llm.linear import code_points, fit, gram_buckets, row_sums, sparse_rows

BITS = 18
SLICE_BYTES = 1 << 20
SCALE = 30.0
PREFIX = 5
QUALITY_FROM = 0.5
TOXIC_BELOW = 0.3

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where a value occurs elsewhere in its row too."""
    key = mixed(values + mixed(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _repeated_words(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each row in windows of ``width`` words that the row has twice or more."""
    if len(words) < width:
        return np.zeros(len(bounds) - 1)
    windows = gram_hashes(words, width)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(rows[: len(windows)] == rows[width - 1 :])
    at = inside[_repeated(windows[inside], rows[inside])]
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return row_sums(np.cumsum(marks[:-1]) > 0, bounds)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(rows)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    first[np.flatnonzero(data == 10) + 1] = True
    starts = np.flatnonzero(first[:-1])
    # a line break is no part of its line: it counts as nothing, and the length of lines is told apart
    codes = byte_codes(data).copy()
    codes[data == 10] = 0
    length = np.diff(starts, append=len(data)) - (data[np.append(starts[1:], len(data)) - 1] == 10)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    lines = mixed(np.add.reduceat(codes * powers[place], starts) + length.astype(np.uint64))
    word_starts, _, _ = word_spans(data, offsets)
    has_word = np.zeros(len(starts), dtype=bool)
    has_word[np.searchsorted(starts, word_starts, "right") - 1] = True
    line_rows = np.searchsorted(offsets, starts, "right") - 1
    lines, line_rows = lines[has_word], line_rows[has_word]
    key = mixed(lines + mixed(line_rows.astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(key, return_index=True)
    total = np.bincount(line_rows, minlength=rows)
    return total - np.bincount(line_rows[once], minlength=rows)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counted columns of a batch of texts."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    in_words = np.zeros(len(data) + 1, dtype=np.int64)
    in_words[starts] += 1
    np.subtract.at(in_words, ends, 1)
    characters = (np.cumsum(in_words[:-1]) > 0) & ((data & 0xC0) != 0x80)
    words = word_hashes(data, starts, ends)
    counted = (
        np.diff(bounds),
        row_sums(characters, offsets),
        row_sums(SYMBOLS[data], offsets),
        _repeated_lines(data, offsets),
        _repeated_words(words, bounds),
    )
    return {name: np.asarray(values).astype(np.int64) for name, values in zip(COUNTS, counted)}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def _shares(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and offsets of character n-grams, words and word pairs."""
    codes, offsets = code_points(column, lower=False)
    data, byte_offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, byte_offsets)
    words = word_hashes(data, starts, ends)
    wide = codes.astype(np.uint64)
    grams = [gram_buckets(wide, offsets, n, BITS) for n in (2, 3, 4)]
    grams += [gram_buckets(words, bounds, n, BITS, seed=100) for n in (1, 2)]
    return grams, [offsets] * 3 + [bounds] * 2


def _presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, buckets)``: each word of letters and each word beginning that a row has, once."""
    data, offsets = text_bytes(column)
    # letters only, in lower case as far as ASCII goes
    folded = np.where(LETTER[data], np.where(data < 128, data | 32, data), 32).astype(np.uint8)
    starts, ends, bounds = word_spans(folded, offsets)
    words = word_hashes(folded, starts, ends)
    begins = mixed(gram_hashes(byte_codes(folded), PREFIX))
    long = ends - starts >= PREFIX
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    shift = np.uint64(64 - BITS)
    bucket = np.concatenate((words >> shift, mixed(begins[starts[long]] + np.uint64(PREFIX)) >> shift))
    key = (np.concatenate((rows, rows[long])) << BITS) | bucket.astype(np.int64)
    key.sort()
    key = key[np.diff(key, prepend=-1) > 0]
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class QualityModel:
    quality: np.ndarray = field(repr=False)
    quality_bias: float
    quality_curve: tuple[float, float]
    toxic: np.ndarray = field(repr=False)
    toxic_bias: float
    toxic_curve: tuple[float, float]

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        grams, offsets = _shares(column)
        sums, total = np.zeros(len(column)), np.zeros(len(column))
        for buckets, own in zip(grams, offsets):
            sums += row_sums(self.quality[buckets], own)
            total += row_sums(buckets < 1 << BITS, own)
        rows, buckets = _presence(column)
        toxic = np.bincount(rows, weights=self.toxic[buckets], minlength=len(column))
        return sums / np.maximum(total, 1) + self.quality_bias, toxic + self.toxic_bias

    def chances(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        quality, toxic = self.logits(column)
        return _logistic(quality, self.quality_curve), _logistic(toxic, self.toxic_curve)


def _logistic(logit: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * logit + curve[1], -500, 500)))


def fitted_curve(logits: np.ndarray, targets: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton's method, towards slightly soft targets."""
    yes, n = targets.sum(), len(targets)
    if not 0 < yes < n:
        return 1.0, 0.0
    soft = np.where(targets, (yes + 1) / (yes + 2), 1 / (n - yes + 2))
    scale = max(float(np.abs(logits).mean()), 1e-9)
    x = np.column_stack((logits / scale, np.ones(n)))
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        theta = theta + np.linalg.solve(hessian, x.T @ (soft - p) - 1e-3 * theta)
    return (float(theta[0]) / scale, float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        column = batch.column(0)
        shares = list(sparse_rows(*_shares(column), BITS))
        rows, buckets = _presence(column)
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        present = [buckets[cuts[r] : cuts[r + 1]].astype(np.int32).tobytes() for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(1),
                batch.column(2),
                batch.column(3),
                pa.array([i.tobytes() for i, _ in shares], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, c in shares], pa.binary()),
                pa.array(present, pa.binary()),
            ],
            names=["share", "quality", "toxic", "buckets", "counts", "present"],
        )


def _head(vectors: list, targets: np.ndarray, aside: np.ndarray, **options) -> tuple[np.ndarray, float, tuple]:
    """Table of weights for class 1 against class 0, bias and curve."""
    learn = [v for v, out in zip(vectors, aside) if not out]
    w = fit(learn, targets[~aside].astype(int), 1 << BITS, 2, **options)
    w = w[:, 1] - w[:, 0]
    logits = np.array([v @ w[i] + w[-1] for i, v in vectors])
    return w, float(w[-1]), fitted_curve(logits[aside], targets[aside])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, calibration_part: float = 0.3) -> QualityModel:
    """A model learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality, toxic).

    Fitted on at most ``sample_rows`` labelled rows, those whose hash is lowest; labels with a null
    and texts without a word are left out.  The driver sees these rows as counts of n-grams.
    """
    known = labels.select("doc_id", "quality", "toxic").na.drop()
    total = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = min(1.0, 1.1 * sample_rows / max(total, 1))
    chosen = known.where(share < part).orderBy(share, "doc_id", "quality", "toxic").limit(sample_rows)
    sample = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(chosen), "doc_id")  # sample_rows at most
        .withColumn("share", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(1000)) / F.lit(1000.0))
        .orderBy("share", "text", "quality", "toxic")
        .limit(sample_rows)
        .select("text", "share", "quality", "toxic")
        .mapInArrow(
            _features, "share double, quality int, toxic int, buckets binary, counts binary, present binary"
        )
        .toArrow()
    )
    rows = [r for r in zip(*(sample.column(c).to_pylist() for c in ("share", "buckets", "quality", "toxic", "counts", "present")))]
    del sample
    rows = sorted(r for r in rows if r[1] or r[5])
    aside = np.array([r[0] >= 1 - calibration_part for r in rows], dtype=bool)
    good = np.array([r[2] == 1 for r in rows], dtype=bool)
    toxic = np.array([r[3] == 1 for r in rows], dtype=bool)
    shares, presence = [], []
    for _, buckets, _, _, counts, present in rows:
        counts = np.frombuffer(counts, np.int32)
        shares.append((np.frombuffer(buckets, np.int32), (counts / max(counts.sum(), 1) * SCALE).astype(np.float32)))
        index = np.frombuffer(present, np.int32)
        presence.append((index, np.ones(len(index), dtype=np.float32)))
    if good.all() or not good.any():  # nothing to tell apart: every text counts as good
        empty = np.zeros((1 << BITS) + 1)
        quality = (empty, 10.0, (1.0, 0.0))
    else:
        quality = _head(shares, good, aside, epochs=3, alpha=0.5, l1=0.001, l2=0.001)
    if toxic.all() or not toxic.any():
        poison = (np.zeros((1 << BITS) + 1), -10.0, (1.0, 0.0))
    else:
        poison = _head(presence, toxic, aside, epochs=3, alpha=0.1, l1=1.5, l2=0.1)
    table = (quality[0] * SCALE).astype(np.float32)
    table[-1] = 0
    return QualityModel(table, quality[1], quality[2], poison[0].astype(np.float32), poison[1], poison[2])


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, p_quality double, p_toxic double"
)


def _scorer(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            counts = base_counts(batch.column(1))
            failed = base_failed(counts)
            quality, toxic = model.chances(batch.column(1))
            kept = ~failed & (quality >= QUALITY_FROM) & (toxic < TOXIC_BELOW)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), **counts, "base_failed": failed, "kept": kept, "p_quality": quality, "p_toxic": toxic}
            )

    return run


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Base counts, verdict and probabilities of whole texts, one row for each row of ``docs``.

    A null or empty text has no words, fails the base rules and is not kept.  Repeated rows get
    equal answers.  An empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
    """
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), RESULT)

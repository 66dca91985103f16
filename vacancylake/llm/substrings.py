"""Substring deduplication with a compressed FM-index per shard (operator 4).

A shard indexes the words of its segments: the Burrows-Wheeler transform sits in a wavelet tree of
packed bits, the alphabet is the shard's own words.  All segments are then streamed through it from
their ends, many at once: backward search keeps the range of suffixes that begin with the longest
match so far, never longer than a window; before a match of full width grows, its last word is
dropped, which widens the range to that of its neighbours with the shorter common prefix.  A match
that can't grow is cut to the longest one that can.  Where a match has the width of a window, the
range holds all its occurrences, and the earliest is read off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacancylake.llm.batches import word_spans
from vacancylake.llm.windows import Windows, without_repeats


class WaveletTree:
    """Ranks of symbols in a sequence, one packed bit row per bit of the alphabet.

    The levels are laid out as a matrix: at each, symbols with a 0 bit come first.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.length = len(symbols)
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            one = (now >> level) & 1 == 1
            padded = np.zeros((len(one) // 64 + 1) * 64, dtype=bool)
            padded[: len(one)] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.int64))
            self.zeros.append(len(one) - int(one.sum()))
            now = np.concatenate((now[~one], now[one]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place after the last level of the prefix ``at``; differences count occurrences."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (symbols >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at


class FmIndex:
    """Backward search over a text of symbols from 1; 0 parts its pieces."""

    def __init__(self, text: np.ndarray, size: int, width: int):
        self.width = width
        self.order, depths = suffix_order(text, width)
        self.tree = WaveletTree(text[self.order - 1], size)
        counts = np.bincount(text, minlength=size)
        self.smaller = np.cumsum(counts) - counts
        self.origin = self.tree.ranks(np.arange(size), np.zeros(size, dtype=np.int64))
        same = _shares_prefix(self.order, depths, width - 1)
        begins = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1
        #: The range of suffixes that share ``width - 1`` symbols with each suffix.
        self.wide_from = begins[run]
        self.wide_to = np.append(begins[1:], len(text))[run]
        self.runs = np.cumsum(~_shares_prefix(self.order, depths, width)) - 1

    def extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the matches with one more symbol in front."""
        shift = self.smaller[symbols] - self.origin[symbols]
        return self.tree.ranks(symbols, low) + shift, self.tree.ranks(symbols, high) + shift

    def _range(self, text: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of ``text[at : at + length]``, searched from their ends."""
        low = np.zeros(len(at), dtype=np.int64)
        high = np.full(len(at), len(self.order), dtype=np.int64)
        for step in range(int(length.max())):
            live = np.flatnonzero((step < length) & (high > low))
            symbols = text[at[live] + length[live] - 1 - step]
            low[live], high[live] = self.extended(symbols, low[live], high[live])
        return low, high

    def _longest(self, text: np.ndarray, at: np.ndarray, most: np.ndarray):
        """``(low, high, length)`` of the longest matches that start at ``at``, of ``most`` symbols at most."""
        least = np.zeros(len(at), dtype=np.int64)
        most = most.copy()
        while np.any(least < most):
            middle = (least + most + 1) // 2
            low, high = self._range(text, at, middle)
            least = np.where(high > low, middle, least)
            most = np.where(high > low, most, middle - 1)
        low, high = self._range(text, at, least)
        return low, high, least

    def matches(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place of the streamed pieces the range start of its full match, else -1."""
        found = np.full(len(text), -1, dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, ends = starts[order], ends[order]
        lengths = ends - starts
        low = np.zeros(len(starts), dtype=np.int64)
        high = np.full(len(starts), len(self.order), dtype=np.int64)
        depth = np.zeros(len(starts), dtype=np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))
            lo, hi, deep = low[:live], high[:live], depth[:live]
            full = deep == self.width
            hi = np.where(full, self.wide_to[np.where(full, lo, 0)], hi)
            lo = np.where(full, self.wide_from[np.where(full, lo, 0)], lo)
            at = ends[:live] - 1 - step
            lo, hi = self.extended(text[at], lo, hi)
            deep = np.minimum(deep + 1, self.width)
            none = np.flatnonzero(hi <= lo)
            if len(none):
                lo[none], hi[none], deep[none] = self._longest(text, at[none], deep[none] - 1)
            low[:live], high[:live], depth[:live] = lo, hi, deep
            whole = depth[:live] == self.width
            found[at[whole]] = low[:live][whole]
        return found


def suffix_order(text: np.ndarray, width: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by their first ``width`` symbols at least, and class numbers by depth 1, 2, 4 ...

    By doubling: the class of twice the depth is the pair of two classes.
    """
    n = len(text)
    classes = text.astype(np.int64)
    depth, kept = 1, {1: classes}
    order = np.argsort(classes, kind="stable")
    while depth < width:
        after = np.zeros(n, dtype=np.int64)
        after[: n - depth] = classes[depth:] + 1
        pair = classes * (int(classes.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        classes = np.empty(n, dtype=np.int64)
        classes[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        depth *= 2
        kept[depth] = classes
    return order, kept


def _shares_prefix(order: np.ndarray, depths: dict[int, np.ndarray], length: int) -> np.ndarray:
    """True where a suffix shares its first ``length`` symbols with the one sorted before it."""
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    done = 0
    for depth in sorted(depths, reverse=True):
        if depth <= length - done:
            classes = depths[depth]
            at = order + done
            value = np.where(at < len(order), classes[np.minimum(at, len(order) - 1)], -1)
            same[1:] &= value[1:] == value[:-1]
            done += depth
    return same


def word_index(width: int):
    """Earliest document of each window of the segments of a shard."""

    def index(segments: list[bytes], routes: np.ndarray, first_d: np.ndarray, first_start: np.ndarray):
        column = pa.array([s + b" " for s in segments], pa.large_binary()).view(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        starts, ends, bounds = word_spans(data, offsets)
        sizes = ends - starts
        places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        keep = np.ones(len(data), dtype=bool)
        keep[ends] = False
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(data[keep].copy())]
        ).dictionary_encode()
        # pieces one after another, each followed by 0
        piece = np.repeat(np.arange(len(segments)), np.diff(bounds))
        text = np.zeros(len(sizes) + len(segments), dtype=np.int64)
        text[np.arange(len(sizes)) + piece] = words.indices.to_numpy().astype(np.int64) + 1
        begin = bounds[:-1] + np.arange(len(segments))
        end = bounds[1:] + np.arange(len(segments))
        fm = FmIndex(text, len(words.dictionary) + 1, width)
        owner = np.searchsorted(begin, np.arange(len(text)), "right") - 1
        earliest = np.full(int(fm.runs[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, fm.runs, first_d[owner[fm.order]])
        found = fm.matches(text, begin, end)
        counts = np.maximum(end - begin - width + 1, 0)
        at = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, counts)]) if len(counts) else begin
        return earliest[fm.runs[found[at]]], np.zeros(len(at), dtype=np.int64), counts

    return index


def deduplicate(docs: DataFrame, width: int = 50, gram: int = 6, **limits: int) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (doc_id, text).

    Removes each word that a window of ``width`` words covers whose words also start in a document
    with a smaller ``doc_id``.  ``kept_sha256`` is of the kept words joined by one space, in UTF-8.

    A null text has no words; texts shorter than a window lose nothing.  A null ``doc_id`` counts
    as larger than all others; rows with equal ids don't remove from each other.  An empty table
    gives no rows.  Other columns are not read.
    """
    spec = Windows(width=width, gram=gram, words=True, within=False, **limits)
    return without_repeats(docs, spec, word_index(width), "n_words")

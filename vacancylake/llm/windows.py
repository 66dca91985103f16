"""Repeated fixed-width windows of long sequences, found shard by shard.

A window is ``width`` consecutive items (words or bytes) of one document.  Shared by the two
operators that remove text which began earlier; they differ in the index that a shard builds.

1. The leftmost smallest gram hash of a window is its anchor.  Equal windows have equal anchors at
   equal places, so only anchors that occur twice can hold repeated windows; they are counted over
   the whole corpus.
2. Consecutive windows with one anchor form a segment, known by the 64-bit hashes of its anchor and
   of its items.  Where segments of repeated anchors occur is kept as numbers.  The items of each
   different segment are taken out of the document it occurs in first and go once to the shard of their
   anchor.  An anchor with very many different segments (copies that differ nearby) goes to no shard: its
   segments are cut into windows, which are grouped by their content.
3. The shard's index tells for every window where it occurs first, as runs of windows that follow
   each other there too.  The answer goes back to all occurrences of the segment, and what began
   earlier is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import (
    byte_codes,
    gram_hashes,
    mixed,
    runs_expanded,
    slices,
    sliding_min,
    text_bytes,
    word_hashes,
    word_spans,
)
from vacancylake.llm.tables import dropped, stored

SLICE_BYTES = 1 << 20
#: Items that are searched for anchors at once; their places fit in 24 bits.
BLOCK = 1 << 23
LAST = (1 << 63) - 1

#: ``(segments, anchors, first documents, first starts)``, in order of anchors, to the first document
#: and start of each window of each segment, and the number of windows of each.
Index = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windows:
    width: int
    gram: int
    #: Items are words, else bytes.
    words: bool
    #: A window of the same document counts as earlier too.
    within: bool
    #: Different segments of one anchor beyond which it is cut into windows; fewer fit in a shard.
    hot_segments: int = 8000
    #: Bytes of different segments that a shard gets, about.
    shard_bytes: int = 2 << 20


class Items:
    """The items of a batch of texts: values to hash, bounds of rows, and their bytes.

    Words are kept as their bytes, each followed by one space.
    """

    def __init__(self, column: pa.Array, words: bool):
        data, offsets = text_bytes(column)
        self.words = words
        if not words:
            self.data, self.bounds = data, offsets
            self.starts = self.ends = None
            return
        starts, ends, self.bounds = word_spans(data, offsets)
        self.spans = data, starts, ends
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        joined = np.full(int(self.ends[-1]) + 1 if len(sizes) else 0, 32, dtype=np.uint8)
        joined[runs_expanded(self.starts, sizes)] = data[runs_expanded(starts, sizes)]
        self.data = joined

    def values(self) -> np.ndarray:
        return word_hashes(*self.spans) if self.words else byte_codes(self.data)

    def text(self, start: int, stop: int) -> bytes:
        """Items ``start:stop`` of the batch; words are parted by one space."""
        if not self.words:
            return self.data[start:stop].tobytes()
        return self.data[self.starts[start] : self.ends[stop - 1]].tobytes() if stop > start else b""

    def byte_spans(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of items ``start:stop`` begin and how many they are; no span is empty."""
        if not self.words:
            return start, stop - start
        return self.starts[start], self.ends[stop - 1] - self.starts[start]

    def without(self, start: int, stop: int, spans: np.ndarray) -> tuple[int, int, bytes]:
        """``(items removed, maximal spans, the rest)`` of items ``start:stop``; spans count from ``start``."""
        marks = np.zeros(stop - start + 1, dtype=np.int64)
        np.add.at(marks, spans[:, 0], 1)
        np.add.at(marks, spans[:, 1], -1)
        gone = np.cumsum(marks[:-1]) > 0
        runs = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
        kept = np.flatnonzero(~gone) + start
        if not self.words:
            return int(gone.sum()), runs, self.data[kept].tobytes()
        sizes = self.ends[kept] + 1 - self.starts[kept]
        rest = self.data[runs_expanded(self.starts[kept], sizes)].tobytes()
        return int(gone.sum()), runs, rest[:-1]


def anchored_runs(values: np.ndarray, bounds: np.ndarray, width: int, gram: int):
    """``(row, first window, windows, anchor)`` of all runs of windows that share one anchor place.

    First windows count from the first item of the batch.
    """
    parts = []
    last = len(values) - width + 1
    valid = np.ones(max(last, 0) + 1, dtype=bool)
    if last > 0:
        # the last width - 1 items of a row start no window
        marks = np.zeros(len(values) + 1, dtype=np.int32)
        np.add.at(marks, np.maximum(bounds[1:] - width + 1, bounds[:-1]), 1)
        np.add.at(marks, bounds[1:], -1)
        valid = np.cumsum(marks[:last]) == 0
    for block in range(0, max(last, 0), BLOCK):
        stop = min(block + BLOCK, last)
        hashes = mixed(gram_hashes(values[block : stop + width - 1], gram))
        key = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_min(key, width - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        at = np.flatnonzero(valid[block:stop])
        if not len(at):
            continue
        place = place[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        parts.append((at[first] + block, np.diff(first, append=len(at)), hashes[place[first]]))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    first, size, anchor = (np.concatenate(x) for x in zip(*parts))
    return np.searchsorted(bounds, first, "right") - 1, first, size, anchor


def _anchors(spec: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            items = Items(batch.column(2), spec.words)
            row, _, _, anchor = anchored_runs(items.values(), items.bounds, spec.width, spec.gram)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(anchor.view(np.int64)))
            keep = pa.array(np.diff(cuts) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists], names=["d", "t", "anchors"]
            ).filter(keep)

    return run


class Runs:
    """Two 64-bit hashes, or one, of any run of values, from running sums."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, values: np.ndarray, hashes: int = 2):
        self.parts = []
        for base in self.BASES[:hashes]:
            powers = np.cumprod(np.full(len(values) + 1, base, dtype=np.uint64))
            back = np.cumprod(np.full(len(values) + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])))
            self.parts.append((sums, back))

    def keys(self, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        extra = mixed(length.astype(np.uint64))
        return [
            mixed((sums[start + length] - sums[start]) * back[start] + extra).view(np.int64) for sums, back in self.parts
        ]


def _segments(spec: Windows):
    """Places of segments, with the number of their items and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            items = Items(batch.column(2), spec.words)
            values = items.values()
            row, first, size, anchor = anchored_runs(values, items.bounds, spec.width, spec.gram)
            wanted = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten().to_numpy().view(np.uint64)
            mix = lambda v, r: mixed(v ^ mixed(r.astype(np.uint64)))
            chosen = np.flatnonzero(np.isin(mix(anchor, row), mix(flat, owner)))
            row, first, anchor = row[chosen], first[chosen], anchor[chosen].view(np.int64)
            length = size[chosen] + spec.width - 1
            (key,) = Runs(values, 1).keys(first, length)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(first - items.bounds[row]),
                    pa.array(anchor),
                    pa.array(key),
                    pa.array(length),
                    pa.array(items.byte_spans(first, first + length)[1]),
                ],
                names=["d", "t", "start", "route", "key", "n", "bytes"],
            )

    return run


def _taken_out(spec: Windows):
    """The bytes of the segments that documents are asked for; words are parted by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            items = Items(batch.column(1), spec.words)
            wanted = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            start, n, route, key = wanted.flatten().flatten()
            first = items.bounds[row] + start.to_numpy()
            begin, sizes = items.byte_spans(first, first + n.to_numpy())
            number = np.cumsum(sizes) // (8 * SLICE_BYTES)
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(row)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                offsets = np.concatenate(([0], np.cumsum(sizes[a:b]))).astype(np.int32)
                data = items.data[runs_expanded(begin[a:b], sizes[a:b])]
                segments = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [route[a:b], key[a:b], batch.column(0).take(pa.array(row[a:b])), start[a:b], segments],
                    names=["route", "key", "first_d", "first_start", "segment"],
                )

    return run


def _single_windows(spec: Windows):
    """The windows of segments, by 128-bit hash, with the place where each occurs first in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "segment", SLICE_BYTES):
            texts = [t + b" " if spec.words else t for t in batch.column(4).to_pylist()]
            items = Items(pa.array(texts, pa.large_binary()).view(pa.large_string()), spec.words)
            counts = np.diff(items.bounds) - spec.width + 1
            row = np.repeat(np.arange(batch.num_rows), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = items.bounds[row] + nth
            key_a, key_b = Runs(items.values()).keys(at, np.full(len(at), spec.width))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(nth),
                    pa.array(key_a),
                    pa.array(key_b),
                    batch.column(2).take(rows),
                    pa.array(batch.column(3).to_numpy()[row] + nth),
                ],
                names=["route", "key", "nth", "window_a", "window_b", "first_d", "first_start"],
            )

    return run


def _indexed(spec: Windows, index: Index):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # rows of one id and text give their segments twice
        rows = rows.sort_values(["route", "segment"]).drop_duplicates(["route", "key"])
        firsts, starts, counts = index(
            rows["segment"].tolist(),
            rows["route"].to_numpy(),
            rows["first_d"].to_numpy(),
            rows["first_start"].to_numpy(),
        )
        begins = np.cumsum(counts) - counts
        nth = np.arange(len(firsts)) - np.repeat(begins, counts)
        moved = starts - nth if spec.within else starts
        new = nth == 0
        new[1:] |= (firsts[1:] != firsts[:-1]) | (moved[1:] != moved[:-1])
        at = np.flatnonzero(new)
        cuts = np.searchsorted(at, begins[1:])
        return pd.DataFrame(
            {
                "route": rows["route"].to_numpy(),
                "key": rows["key"].to_numpy(),
                "windows": counts,
                "nths": np.split(nth[at], cuts),
                "first_ds": np.split(firsts[at], cuts),
                "first_starts": np.split(starts[at], cuts),
            }
        )

    return run


def _earlier(spec: Windows):
    """Spans of items, by document, that began earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            documents, texts, starts, windows = (batch.column(k).to_numpy() for k in range(4))
            counts = np.diff(batch.column(4).offsets.to_numpy())
            nth, first_d, first_start = (batch.column(k).flatten().to_numpy() for k in (4, 5, 6))
            row = np.repeat(np.arange(batch.num_rows), counts)
            # a run of windows ends where the next one of its segment begins
            stop = np.append(nth[1:], 0)
            stop[np.cumsum(counts) - 1] = windows
            gone = first_d < documents[row]
            if spec.within:
                gone |= (first_d == documents[row]) & (first_start < starts[row] + nth)
            hit = np.flatnonzero(gone)
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
            begin = hit[new]
            end = hit[np.append(new[1:], True)] if len(hit) else hit
            own = row[begin]
            yield pa.RecordBatch.from_pydict(
                {
                    "d": documents[own],
                    "t": texts[own],
                    "b": starts[own] + nth[begin],
                    "e": starts[own] + stop[end] + spec.width - 1,
                }
            )

    return run


def _cleaned(spec: Windows, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            items = Items(batch.column(1), spec.words)
            begins, ends = batch.column(2), batch.column(3)
            total, removed, spans, digests = [], [], [], []
            for row in range(batch.num_rows):
                start, stop = int(items.bounds[row]), int(items.bounds[row + 1])
                total.append(stop - start)
                gone, runs = 0, 0
                if begins[row].is_valid:
                    both = np.column_stack((begins[row].values.to_numpy(), ends[row].values.to_numpy()))
                    gone, runs, rest = items.without(start, stop, both)
                else:
                    rest = items.text(start, stop)
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), unit: total, "n_removed": removed, "n_spans": spans, "kept_sha256": digests}
            )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, d, t, text``: ``d`` orders documents, a null id last; ``d`` and ``t`` tell rows apart."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64("text").alias("t"),
        "text",
    )


def repeated_spans(docs: DataFrame, spec: Windows, index: Index) -> DataFrame:
    """``(d, t, begins, ends)``: items of each document that a window covers which began earlier."""
    rows = keyed(docs)
    anchors = stored(
        rows.select("d", "t", "text").mapInArrow(_anchors(spec), "d long, t long, anchors array<long>"), "anchors"
    )
    each = anchors.select("d", "t", F.explode("anchors").alias("anchor"))
    if spec.within:
        repeated = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    else:
        repeated = each.groupBy("anchor").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high")
    hits = stored(
        anchors.select("d", "t", F.explode(F.array_distinct("anchors")).alias("anchor"))
        .join(repeated.select("anchor"), "anchor")
        .groupBy("d", "t")
        .agg(F.collect_list("anchor").alias("wanted")),
        "hits",
    )
    dropped(anchors)
    place = "d long, t long, start long, route long, key long, n long, bytes long"
    segments = stored(
        rows.select("d", "t", "text").join(hits, ["d", "t"]).mapInArrow(_segments(spec), place), "segments"
    )
    dropped(hits)
    keys = ["route", "key"]
    first = F.min(F.struct("d", "start", "t", "n", "bytes")).alias("first")
    different = stored(segments.groupBy(*keys).agg(first).select(*keys, "first.*"), "different")
    hot = stored(
        different.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > spec.hot_segments).select("route"), "hot"
    )
    has_hot = hot.count() > 0
    # apart from the join with whole texts, so that its shuffles are gone when shards are dealt
    items = stored(_with_items(spec, rows, different), "items")
    usual = different.join(hot, "route", "left_anti") if has_hot else different
    size = usual.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-size // spec.shard_bytes))
    dropped(different)
    answer = "route long, key long, windows long, nths array<long>, first_ds array<long>, first_starts array<long>"
    answers = (
        (items.join(hot, "route", "left_anti") if has_hot else items)
        .withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_indexed(spec, index), answer)
    )
    of_hot = [_answers_of_hot(spec, items.join(hot, "route"))] if has_hot else []
    for more in of_hot:
        answers = answers.unionByName(more)
    answers = stored(answers, "answers")
    dropped(items, hot, *of_hot)
    spans = (
        segments.select("d", "t", "start", *keys)
        .join(answers, keys)
        .select("d", "t", "start", "windows", "nths", "first_ds", "first_starts")
        .mapInArrow(_earlier(spec), "d long, t long, b long, e long")
    )
    out = stored(
        spans.distinct()
        .groupBy("d", "t")
        .agg(F.collect_list(F.struct("b", "e")).alias("spans"))
        .select("d", "t", F.col("spans.b").alias("begins"), F.col("spans.e").alias("ends")),
        "spans",
    )
    dropped(segments, answers)
    return out


def _with_items(spec: Windows, rows: DataFrame, different: DataFrame) -> DataFrame:
    """``route, key, first_d, first_start, segment``: the bytes of different segments, from the documents they occur in first."""
    # in order of places: neighbours overlap, and are written in little room side by side
    asked = F.sort_array(F.collect_list(F.struct("start", "n", "route", "key"))).alias("asked")
    asked = different.groupBy("d", "t").agg(asked)
    return (
        rows.select("d", "t", "text")
        .join(asked, ["d", "t"])
        .select("d", "text", "asked")
        .mapInArrow(_taken_out(spec), "route long, key long, first_d long, first_start long, segment binary")
    )


def _answers_of_hot(spec: Windows, segments: DataFrame) -> DataFrame:
    """First places of the windows of segments whose anchor has too many for a shard, by grouping windows."""
    single = stored(
        segments.select("route", "key", "first_d", "first_start", "segment").mapInArrow(
            _single_windows(spec),
            "route long, key long, nth long, window_a long, window_b long, first_d long, first_start long",
        ),
        "single",
    )
    windows = ["window_a", "window_b"]
    earliest = single.groupBy(*windows).agg(F.min(F.struct("first_d", "first_start")).alias("first"))
    # one segment's windows, each a run of its own
    placed = F.sort_array(F.collect_set(F.struct("nth", "first.first_d", "first.first_start")))
    answers = (
        single.select("route", "key", "nth", *windows)
        .join(earliest, windows)
        .groupBy("route", "key")
        .agg(placed.alias("p"))
        .select(
            "route",
            "key",
            F.size("p").cast("long").alias("windows"),
            F.col("p.nth").alias("nths"),
            F.col("p.first_d").alias("first_ds"),
            F.col("p.first_start").alias("first_starts"),
        )
    )
    answers = stored(answers, "hot-answers")
    dropped(single)
    return answers


def without_repeats(docs: DataFrame, spec: Windows, index: Index, unit: str) -> DataFrame:
    """``doc_id``, number of items (``unit``), ``n_removed, n_spans, kept_sha256`` of every row."""
    spans = repeated_spans(docs, spec, index)
    return (
        keyed(docs)
        .join(spans, ["d", "t"], "left")
        .select("doc_id", "text", "begins", "ends")
        .mapInArrow(
            _cleaned(spec, unit), f"doc_id long, {unit} long, n_removed long, n_spans long, kept_sha256 string"
        )
    )

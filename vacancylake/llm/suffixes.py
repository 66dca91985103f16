"""Suffix-array deduplication of bytes (operator 5).

The segments of a Spark partition are laid out in shards of bounded size.  Each shard is sorted
into a suffix array by Larsson and Sadakane's refinement: suffixes are ordered by eight bytes, then
groups that are still tied are ordered by the rank of what follows them, at twice the depth each
time.  Kasai's common prefixes, computed for all segments side by side, cut the array into windows
that are equal.  Equal windows have one anchor, and only an anchor whose segments lie across two
shards can have equal windows in both: those are merged by binary search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vacancylake.llm.batches import runs_expanded
from vacancylake.llm.windows import Windows, without_repeats

#: Never a byte of UTF-8, so no window reaches over it.
BORDER = 0xFF


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data) + 1] << np.uint64(8 * (7 - k))
    return out


def suffix_array(data: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, rank)`` of all suffixes by their first ``depth`` bytes at least."""
    n = len(data)
    order = np.argsort(keys[:n])
    ordered = keys[:n][order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    done = 8
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while done < depth and len(tied):
        suffix = order[tied]
        after = suffix + done
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 2) + following
        by = np.argsort(key)
        order[tied] = suffix = suffix[by]
        key = key[by]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[suffix] = tied[first]
        tied = tied[~(new & np.append(new[1:], True))]
        done *= 2
    return order, rank


def common_prefixes(
    keys: np.ndarray, order: np.ndarray, place: np.ndarray, starts: np.ndarray, windows: np.ndarray, most: int
) -> np.ndarray:
    """By text place, the bytes shared with the suffix sorted before, ``most`` being enough.

    One place after another, all segments at once; the prefix shrinks by at most one each time where
    the place after the neighbour stays before: suffixes tied beyond ``most`` are in any order.
    """
    out = np.zeros(len(order), dtype=np.int64)
    lanes = np.argsort(-windows, kind="stable")
    starts, windows = starts[lanes], windows[lanes]
    shared = np.zeros(len(starts), dtype=np.int64)
    neighbour = np.zeros(len(starts), dtype=np.int64)
    for step in range(int(windows[0]) if len(windows) else 0):
        live = int(np.searchsorted(-windows, -step, "left"))
        at = starts[:live] + step
        h = np.maximum(shared[:live] - 1, 0)
        before = order[np.maximum(place[at] - 1, 0)]
        h[place[np.minimum(neighbour[:live] + 1, len(order) - 1)] >= place[at]] = 0
        neighbour[:live] = before
        going = np.flatnonzero((place[at] > 0) & (h < most))
        while len(going):
            left = np.minimum(at[going] + h[going], len(keys) - 1)
            right = np.minimum(before[going] + h[going], len(keys) - 1)
            differ = keys[left] ^ keys[right]
            alike = np.zeros(len(going), dtype=np.int64)
            for k in range(1, 9):
                alike += (differ >> np.uint64(64 - 8 * k)) == 0
            ends = (left == len(keys) - 1) | (right == len(keys) - 1)
            h[going] += alike
            going = going[(alike == 8) & ~ends & (h[going] < most)]
        shared[:live] = h
        out[at] = h
    return out


def window_keys(keys: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The bytes of the windows ``at`` as rows of numbers that compare like them."""
    parts = [keys[at + k] for k in range(0, width - 7, 8)]
    if width % 8:
        parts.append(keys[at + width - width % 8] >> np.uint64(64 - 8 * (width % 8)))
    return np.column_stack(parts)


def binary_search(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row of ``wanted`` the equal row of sorted ``known``, or -1."""
    low = np.zeros(len(wanted), dtype=np.int64)
    high = np.full(len(wanted), len(known), dtype=np.int64)
    rows = np.arange(len(wanted))
    while np.any(low < high):
        middle = (low + high) // 2
        row = known[np.minimum(middle, len(known) - 1)]
        differs = row != wanted
        column = differs.argmax(axis=1)
        smaller = differs.any(axis=1) & (row[rows, column] < wanted[rows, column])
        open_ = low < high
        low = np.where(open_ & smaller, middle + 1, low)
        high = np.where(open_ & ~smaller, middle, high)
    inside = low < len(known)
    equal = inside & (known[np.minimum(low, len(known) - 1)] == wanted).all(axis=1)
    return np.where(equal, low, -1)


def byte_index(width: int, shard_bytes: int):
    """Earliest place of each window of the segments of a partition, which come by anchor."""

    def shard(segments: list[bytes]):
        """``(keys, places of windows, their groups, a place of each group, windows of each segment)``."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        data = np.frombuffer(bytes([BORDER]).join([*segments, b""]), np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        keys = eight_bytes(data)
        order, place = suffix_array(data, keys, width)
        position = np.empty(len(data), dtype=np.int64)
        position[order] = np.arange(len(data))
        windows = np.maximum(sizes - width + 1, 0)
        shared = common_prefixes(keys, order, position, starts, windows, width)
        at = runs_expanded(starts, windows)
        by = np.argsort(position[at])
        new = shared[at[by]] < width
        group = np.empty(len(at), dtype=np.int64)
        group[by] = np.cumsum(new) - 1
        leader = at[by[new]]
        return keys, at, group, leader, windows

    def index(segments: list[bytes], routes: np.ndarray, first_d: np.ndarray, first_start: np.ndarray):
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        number = (np.cumsum(sizes) - sizes) // shard_bytes
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(segments)]))
        counts = np.maximum(sizes - width + 1, 0)
        owner = np.repeat(np.arange(len(segments)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        documents, starts = first_d[owner], first_start[owner] + nth
        by = np.lexsort((starts, documents))
        order = np.empty(len(owner), dtype=np.int64)
        order[by] = np.arange(len(owner))

        group = np.empty(len(owner), dtype=np.int64)
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        groups, window = 0, 0
        tail = None
        for a, b in zip(cuts[:-1], cuts[1:]):
            keys, at, own, leader, windows = shard(segments[a:b])
            own = own + groups
            group[window : window + len(at)] = own
            route = np.repeat(routes[a:b], windows)
            if tail is not None and len(route) and route[0] == tail[0]:
                head = np.unique(own[route == route[0]])
                found = binary_search(tail[2], window_keys(keys, leader[head - groups], width))
                merged.append((tail[1][found[found >= 0]], head[found >= 0]))
            if len(route):
                last = np.unique(own[route == route[-1]])
                tail = (route[-1], last, window_keys(keys, leader[last - groups], width))
            groups += len(leader)
            window += len(at)
        earliest = np.full(groups, len(owner), dtype=np.int64)
        np.minimum.at(earliest, group, order)
        for left, right in [*merged, *merged[::-1]]:  # along the shards and back
            both = np.minimum(earliest[left], earliest[right])
            earliest[left] = earliest[right] = both
        best = by[earliest[group]] if len(owner) else by
        return documents[best], starts[best], counts

    return index


def deduplicate(docs: DataFrame, width: int = 100, gram: int = 24, shard_bytes: int = 2 << 20, **limits: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (doc_id, text).

    Removes each UTF-8 byte that a string of ``width`` bytes covers which also starts earlier: in a
    document with a smaller ``doc_id``, or before in the same one.

    A null text is empty; shorter texts lose nothing.  A null ``doc_id`` counts as larger than all
    others, and rows of one id as one document, each from byte 0.  An empty table gives no rows.
    Other columns are not read.
    """
    spec = Windows(width=width, gram=gram, words=False, within=True, **limits)
    return without_repeats(docs, spec, byte_index(width, shard_bytes), "n_bytes")

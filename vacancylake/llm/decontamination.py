"""Benchmark decontamination by the q-gram lemma (operator 6).

Documents and benchmark items are compared as lower-case letters and digits parted by single
spaces.  An item is cut into overlapping pieces; a document leaks it when some part of the document
is within the edit budget of a piece.  A piece of ``m`` signs with ``k`` edits shares at least
``m + 1 - q - k * q`` of its q-grams with what it became, all on diagonals at most ``k`` apart.  So
shared q-grams are counted in overlapping bands of diagonals, only bands that reach the bound are
kept, and an alignment restricted to the band decides.  Grams are counted over the item first, and over
its pieces only in bands that have enough for one.  An item too short for any edit must stand in the
document as whole words.

The benchmark is the query set: its q-grams go to every task, in blocks of bounded size.  Documents
are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import gram_hashes, mixed, runs_expanded, slices
from vacancylake.llm.linear import code_points, letters_and_digits

SLICE_BYTES = 1 << 20
#: Candidates aligned together; their costs stay in a core's cache.
ALIGNED = 512
FILTER_BITS = 20


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, offsets)``: letters and digits in lower case, all other runs as one space between them."""
    codes, offsets = code_points(column, lower=True)
    if not len(codes):
        return codes, offsets
    keep = letters_and_digits(codes)
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[offsets] = True
    # a run of other signs stays as one space where it follows a sign of the same text
    space = ~keep
    space[1:] &= keep[:-1]
    space &= ~begins[:-1]
    flat = np.where(keep, codes, np.uint32(32))[keep | space]
    new = np.concatenate(([0], np.cumsum(keep | space)))[offsets]
    return flat, new


@dataclass
class Pieces:
    """Benchmark items that share a gram size, ready to be looked up; ``slot_of`` and ``place_of`` say where a gram is.

    The pieces of an item have one length and one budget; ``begins`` has the places where they begin,
    those of one item after the other.  ``bordered`` items must stand between borders of words.
    """

    q: int
    items: np.ndarray
    texts: list[np.ndarray]
    sizes: np.ndarray
    budgets: np.ndarray
    bordered: np.ndarray
    needed: np.ndarray
    begins: np.ndarray
    pieces_from: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    slot_of: np.ndarray
    place_of: np.ndarray
    listed: np.ndarray


def prepared(items: list[tuple[int, str]], piece: int, stride: int, budget: float, q_most: int) -> list[Pieces]:
    """The pieces of ``items`` by gram size; a shorter piece may need shorter grams for the lemma to hold."""
    by_q: dict[int, list[tuple[int, np.ndarray, int, int]]] = {}
    for item, text in items:
        codes, _ = normalized(pa.array([text], pa.large_string()))
        codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
        if not len(codes):
            continue
        size = min(piece, len(codes))
        edits = int(budget * size)
        by_q.setdefault(min(q_most, size // (edits + 1)), []).append((item, codes, size, edits))
    out = []
    for q, parts in sorted(by_q.items()):
        sizes = np.array([size for _, _, size, _ in parts])
        budgets = np.array([k for _, _, _, k in parts])
        begins = [[*range(0, len(c) - size, stride), len(c) - size] for _, c, size, _ in parts]
        hashes = [mixed(gram_hashes(c.astype(np.uint64), q)) for _, c, _, _ in parts]
        counts = np.array([len(h) for h in hashes])
        all_hashes = np.concatenate(hashes)
        order = np.argsort(all_hashes, kind="stable")
        grams, first = np.unique(all_hashes[order], return_index=True)
        listed = np.zeros(1 << FILTER_BITS, dtype=bool)
        listed[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        out.append(
            Pieces(
                q=q,
                items=np.array([i for i, *_ in parts], dtype=np.int64),
                texts=[c for _, c, _, _ in parts],
                sizes=sizes,
                budgets=budgets,
                bordered=np.array([k == 0 and size == len(c) for _, c, size, k in parts]),
                needed=sizes + 1 - q - budgets * q,
                begins=np.concatenate(begins).astype(np.int64),
                pieces_from=np.cumsum([0, *map(len, begins)]),
                grams=grams,
                first=np.append(first, len(all_hashes)),
                slot_of=np.repeat(np.arange(len(parts)), counts)[order],
                place_of=runs_expanded(np.zeros(len(parts), dtype=np.int64), counts)[order],
                listed=listed,
            )
        )
    return out


def _hits(pieces: Pieces, codes: np.ndarray, offsets: np.ndarray):
    """``(row, slot, place, diagonal)`` of the grams that texts share with items, where an item has enough of them."""
    hashes = mixed(gram_hashes(codes.astype(np.uint64), pieces.q))
    at = np.flatnonzero(pieces.listed[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    gram = np.searchsorted(pieces.grams, hashes[at])
    real = pieces.grams[np.minimum(gram, len(pieces.grams) - 1)] == hashes[at]
    at, gram = at[real], gram[real]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + pieces.q <= offsets[row + 1]
    at, gram, row = at[inside], gram[inside], row[inside]
    counts = pieces.first[gram + 1] - pieces.first[gram]
    entry = runs_expanded(pieces.first[gram], counts)
    row, at = np.repeat(row, counts), np.repeat(at, counts)
    slot = pieces.slot_of[entry]
    # cheap first: enough grams of the item anywhere in the text
    pair = row * len(pieces.items) + slot
    total = np.bincount(pair, minlength=0)
    enough = np.flatnonzero(total[pair] >= pieces.needed[slot])
    row, at, slot, place = row[enough], at[enough], slot[enough], pieces.place_of[entry[enough]]
    return row, slot, place, at - offsets[row] - place


def _in_pieces(pieces: Pieces, row: np.ndarray, slot: np.ndarray, place: np.ndarray, line: np.ndarray):
    """``(row, slot, begin, line, count)``: shared grams of each piece on each line, where a piece has enough.

    ``line`` is a diagonal or a band.  An item must have enough on the line before its pieces are looked at.
    """
    if not len(row):
        return (np.zeros(0, np.int64),) * 5
    lowest = line.min()
    key = (row * len(pieces.items) + slot) * (line.max() - lowest + 1) + line - lowest
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    size = np.diff(new, append=len(key))
    kept = size >= pieces.needed[slot[order[new]]]
    new, size = new[kept], size[kept]
    of_hit, order = np.repeat(np.arange(len(new)), size), order[runs_expanded(new, size)]
    if not len(order):
        return (np.zeros(0, np.int64),) * 5
    width = np.int64(max(map(len, pieces.texts)) + 1)
    at = np.sort(of_hit * width + place[order])
    head = order[np.cumsum(size) - size]
    n = np.diff(pieces.pieces_from)[slot[head]]
    group = np.repeat(np.arange(len(head)), n)
    begin = pieces.begins[runs_expanded(pieces.pieces_from[slot[head]], n)]
    last = begin + pieces.sizes[slot[head]][group] - pieces.q
    count = np.searchsorted(at, group * width + last, "right") - np.searchsorted(at, group * width + begin)
    enough = count >= pieces.needed[slot[head]][group]
    head = head[group[enough]]
    return row[head], slot[head], begin[enough], line[head], count[enough]


def _candidates(pieces: Pieces, row: np.ndarray, slot: np.ndarray, place: np.ndarray, diagonal: np.ndarray):
    """``(row, slot, begin, first diagonal, least edits)`` of bands with enough shared grams of a piece.

    Diagonals count from the text's start.  Bands are ``2 * (k + 1)`` wide and begin every ``k + 1``,
    so any ``k + 1`` neighbouring diagonals lie in one.  An edit takes ``q`` grams of a piece at most.
    """
    step = pieces.budgets[slot] + 1
    band = diagonal // step
    row, slot, place, band = (np.concatenate(x) for x in ((row, row), (slot, slot), (place, place), (band, band - 1)))
    # a gram that occurs twice on a band counts once for each place of the text, never less than needed
    row, slot, begin, band, count = _in_pieces(pieces, row, slot, place, band)
    missing = np.maximum(pieces.sizes[slot] + 1 - pieces.q - count, 0)
    return row, slot, begin, band * (pieces.budgets[slot] + 1), -(-missing // pieces.q)


def banded_distance(
    pieces: np.ndarray, texts: np.ndarray, starts: np.ndarray, stops: np.ndarray, diagonals: np.ndarray, budget: int
) -> tuple[np.ndarray, np.ndarray]:
    """Least edits that turn each row of ``pieces`` into a part of ``texts[start:stop]``, and where it ends.

    Alignments stay on the diagonals from ``budget`` before a band to ``budget`` after it; the text's
    part may begin and end anywhere.  All candidates advance one sign of their pieces at a time; those
    that have more edits than the budget go no further, and their least edits are given as beyond it.
    """
    width, length = 4 * budget + 3, pieces.shape[1]
    big = length + width + 1
    kind = np.int16 if big < 10_000 else np.int64
    column = np.arange(width, dtype=kind)
    # place in the text of piece sign 0 on each diagonal, and of those after it
    at = diagonals[:, None] - budget + np.arange(width + length)
    size = (stops - starts)[:, None]
    here = texts[starts[:, None] + np.clip(at, 0, size - 1)]
    wall = np.where((at >= 0) & (at <= size), 0, big).astype(kind)
    least, ends = np.full(len(at), big, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    rows = np.arange(len(at))
    # cost[c]: best alignment of the piece so far that ends before text place ``at[c + i]``
    cost = wall[:, :width]
    edge = np.full((len(at), 1), big, dtype=kind)
    for i in range(length):
        best = cost + (here[:, i : i + width] != pieces[:, i : i + 1])  # sign against sign: same diagonal
        skip = np.concatenate((cost[:, 1:], edge), axis=1) + kind(1)  # sign left out
        best = np.minimum(best, skip) - column
        # a text sign put in: along the row, each costing one
        cost = np.minimum(np.minimum.accumulate(best, axis=1) + column, kind(big))
        cost = np.maximum(cost, wall[:, i + 1 : i + 1 + width])
        if i % 8 == 7:
            alive = cost.min(axis=1) <= budget
            if np.count_nonzero(alive) < 0.9 * len(alive):
                cost, here, wall, pieces, edge, rows = (x[alive] for x in (cost, here, wall, pieces, edge, rows))
                if not len(rows):
                    return least, ends
    end = cost.argmin(axis=1)
    least[rows] = cost[np.arange(len(rows)), end]
    ends[rows] = diagonals[rows] - budget + end + length
    return least, ends


def _aligned(pieces: Pieces, codes: np.ndarray, offsets: np.ndarray, found: tuple, best: dict) -> None:
    """Align candidates of ``found`` and note in ``best`` what is within budget."""
    row, slot, begin, diagonal, _ = found
    sizes = pieces.sizes[slot]
    for size in np.unique(sizes):  # pieces of one length have one budget
        own = np.flatnonzero(sizes == size)
        budget = int(pieces.budgets[slot[own[0]]])
        for at in range(0, len(own), ALIGNED):
            some = own[at : at + ALIGNED]
            rows = row[some]
            parts = np.stack([pieces.texts[i][b : b + size] for i, b in zip(slot[some], begin[some])])
            edits, ends = banded_distance(parts, codes, offsets[rows], offsets[rows + 1], diagonal[some], budget)
            for k in np.flatnonzero(edits <= budget):
                key, new = (int(rows[k]), int(pieces.items[slot[some[k]]])), (int(edits[k]), int(ends[k]))
                best[key] = min(best.get(key, new), new)


def _between_borders(codes: np.ndarray, start: int, stop: int, first: int, last: int) -> bool:
    """Whether words begin at ``start`` and end at ``stop`` of the text that is ``codes[first:last]``."""
    return (start == first or codes[start - 1] == 32) and (stop == last or codes[stop] == 32)


def leaks_of(column: pa.Array, blocks: list[Pieces]) -> list[tuple[int, int, int, int]]:
    """``(row, item, edits, end)`` of a batch of texts: the best match of each item in each text.

    Pieces that stand in a text as they are need no alignment, those without a budget are only found so.  Of the others, those that share most
    are aligned first, and then those that may still be as good as the best match of their item.
    """
    codes, offsets = normalized(column)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for pieces in blocks:
        if len(codes) < pieces.q:
            continue
        hits = _hits(pieces, codes, offsets)
        row, slot, begin, diagonal, count = _in_pieces(pieces, *hits)
        for k in np.flatnonzero(count == pieces.sizes[slot] + 1 - pieces.q):
            size = int(pieces.sizes[slot[k]])
            end = int(begin[k] + diagonal[k]) + size
            start = int(offsets[row[k]]) + end - size
            if pieces.bordered[slot[k]] and not _between_borders(codes, start, start + size, offsets[row[k]], offsets[row[k] + 1]):
                continue
            if np.array_equal(codes[start : start + size], pieces.texts[slot[k]][begin[k] : begin[k] + size]):
                key = (int(row[k]), int(pieces.items[slot[k]]))
                best[key] = min(best.get(key, (0, end)), (0, end))
        # a piece of the item stands at ``begin`` of it, so its diagonals are those of the item moved on
        row, slot, begin, diagonal, least = _candidates(pieces, *hits)
        # where no edit is allowed, all there is has been found
        row, slot, begin, diagonal, least = (x[pieces.budgets[slot] > 0] for x in (row, slot, begin, diagonal, least))
        found = (row, slot, begin, diagonal + begin, least)
        keys = list(zip(row.tolist(), pieces.items[slot].tolist()))
        order = np.lexsort((least, pieces.items[slot], row))
        first = {keys[k]: k for k in order[::-1].tolist()}
        now = np.array(sorted(k for key, k in first.items() if best.get(key, (1, 0))[0] > 0), dtype=np.int64)
        _aligned(pieces, codes, offsets, tuple(x[now] for x in found), best)
        done = set(now.tolist())
        rest = [
            k for k, key in enumerate(keys)
            if k not in done and 0 < best.get(key, (len(codes), 0))[0] and least[k] <= best.get(key, (len(codes), 0))[0]
        ]
        _aligned(pieces, codes, offsets, tuple(x[np.array(rest, dtype=np.int64)] for x in found), best)
    return [(row, item, edits, end) for (row, item), (edits, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` signs, each of which fits in a task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in part.collect()]
        if rows:
            yield sorted(rows)


@dataclass(frozen=True)
class Search:
    """``piece`` signs at a time, every ``stride``; ``budget`` edits for each sign; grams of ``q`` at most.

    Pieces begin at most one edit budget apart.  So every verbatim quote of 108 signs or more of an item of 120
    or more has a piece within budget wherever it begins: what the piece has before and after the quote is 12 signs
    at most.  Quotes of 131 signs and more hold a whole piece and may have the budget in edits besides.
    """

    piece: int = 120
    stride: int = 12
    budget: float = 0.1
    q: int = 8
    block_chars: int = 2_000_000

    def blocks(self, benchmark: DataFrame) -> Iterator[list[Pieces]]:
        for items in _blocks(benchmark, self.block_chars):
            yield prepared(items, self.piece, self.stride, self.budget, self.q)


LEAKS = "doc_id long, item_id long, edits int, end_char long"


def leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """``doc_id, item_id, edits, end_char``: every item that a document holds, whole or in a piece.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``.  An item is held when one of
    its pieces is within the edit budget of some part of the document; ``edits`` is the least number
    over its pieces and ``end_char`` where that match ends in the normalised text, the first of ties.
    An item so short that its budget is no edit at all (under 10 signs as searched by default) is held
    only as whole words: ``cat`` is in ``the cat sat``, not in ``concatenated``.

    Null and empty texts hold nothing, and items without a letter or digit are in none.  A null
    ``item_id`` is given as -1.  Repeated documents give repeated rows, repeated items one.  Without
    documents or items there are no rows.  Other columns are not read.
    """

    def finder(blocks: list[Pieces]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE_BYTES):
                found = leaks_of(batch.column(1), blocks)
                rows, items, edits, ends = zip(*found) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(items, pa.int64()),
                        pa.array(edits, pa.int32()),
                        pa.array(ends, pa.int64()),
                    ],
                    names=["doc_id", "item_id", "edits", "end_char"],
                )

        return run

    texts = docs.select("doc_id", "text")
    out = None
    for blocks in search.blocks(benchmark):
        part = texts.mapInArrow(finder(blocks), LEAKS)
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], LEAKS) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``, as ``leaks`` tells it.

    Items too short for an edit are held only as whole words.
    A null or empty text holds nothing and stays; null and empty items are held by no text, and
    repeated ones are one.  Repeated rows share their fate, ``doc_id`` is not looked at, and texts of any
    length are searched whole.  Without items all rows stay; an empty table gives no rows.
    """

    def cleaner(blocks: list[Pieces], at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE_BYTES):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in leaks_of(batch.column(at), blocks)]] = False
                out = batch.filter(pa.array(keep))
                yield out.set_column(at, "text", out.column(at).cast(pa.string()))

        return run

    schema = docs.schema
    for blocks in search.blocks(benchmark):
        docs = docs.mapInArrow(cleaner(blocks, docs.columns.index("text")), schema)
    return docs

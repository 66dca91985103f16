"""Best-fit packing of tokenized documents into sequences of bounded length (operator 1).

Hierarchical residual packing.  Every partition of the scan tokenizes its documents and packs the
pieces by best fit, longest first.  Bins that are nearly full leave at once.  The others go on as
items: groups of partitions are merged in a tree, and each merge packs the underfull bins again by
best fit, until one group is left.

After best fit no two bins of a group are at most half full, so a merge can only put the one small
bin of each group into another group's gap.  A group therefore hands on at most ``carry`` of its
emptiest bins; what it keeps back could not have been filled by the few small bins it will meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import runs_expanded, slices, text_bytes, word_spans
from vacancylake.llm.tables import stored

SLICE_BYTES = 4 << 20
END_ID = 1

#: Of each byte: 0 whitespace or part of a longer sign, 1 ASCII letter, 2 other ASCII, 3 apostrophe.
SIGN = np.zeros(256, dtype=np.uint8)
SIGN[33:127] = 2
SIGN[65:91] = SIGN[97:123] = 1
SIGN[39] = 3

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "bin long, place long, fill long, part int, carried boolean"
)
MOVES = "bin long, target long, shift long, fill long, part int, carried boolean"


class WordTokenizer:
    """Token ids of texts by way of their words.

    The vocabulary lower-cases, drops whitespace and joins neither across it nor across the border of
    a letter and another sign, so the ids of a text are those of such parts in order.  Parts seen
    before are looked up; the table starts anew when it holds ``max_words``.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>", max_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = separator
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.max_words = max_words
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 15, np.int64)
        self.lengths = np.zeros(1 << 15, np.int64)
        self.used = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of the words, one after another.

        Words of letters end in one token that says so; other parts go through the tokenizer
        parted by a special token.
        """
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            if all(map(str.isalpha, part)):
                found = self._ids(" ".join(part))
                ends = np.flatnonzero(self.ends_word[found]) + 1
                if len(ends) == len(part) and ends[-1] == len(found):
                    ids.append(found)
                    lengths.append(np.diff(ends, prepend=0))
                    continue
            if any(self.separator in word for word in part):
                each = [self._ids(word) for word in part]
                ids.extend(each)
                lengths.append(np.array([len(x) for x in each], dtype=np.int64))
                continue
            found = self._ids(f" {self.separator} ".join([*part, ""]).rstrip(" "))
            between = found == self.separator_id
            ids.append(found[~between])
            lengths.append(np.diff(np.flatnonzero(between), prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[str]) -> None:
        words = sorted(words, key=str.isalpha)
        ids, lengths = self._encode(words)
        have, need = len(self.places), len(ids)
        while self.used + need > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while have + len(words) > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        self.ids[self.used : self.used + need] = ids
        self.starts[have : have + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[have : have + len(words)] = lengths
        self.used += need
        self.places.update(zip(words, range(have, have + len(words))))

    @staticmethod
    def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, lower-cased where that is safe, and spans of the parts that words fall into."""
        kind = SIGN[data]
        follows = np.concatenate((data[1:], [32]))
        lowered = np.where((data >= 65) & (data <= 90) & (follows < 128), data | 32, data).astype(np.uint8)
        # 1 letter, 2 other sign, 3 apostrophe, which may join the letters after it
        cut = ((kind[:-1] == 1) & (kind[1:] >= 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))
        cuts = np.flatnonzero(cut) + 1
        begins, stops = np.zeros(len(data), dtype=bool), np.zeros(len(data) + 1, dtype=bool)
        begins[starts] = begins[cuts] = True  # where texts touch, a border is there already
        stops[ends] = stops[cuts] = True
        return lowered, np.flatnonzero(begins), np.flatnonzero(stops)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: row ``r`` of the text column has ``ids[bounds[r]:bounds[r + 1]]``."""
        data, offsets = text_bytes(column)
        starts, ends, _ = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not np.any((data[:-1] == 60) & (data[1:] == 124)):  # no "<|" that may begin a special token
            data, starts, ends = self._parts(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        sizes = ends - starts
        letters = data[runs_expanded(starts, sizes)]
        places = np.concatenate(([0], np.cumsum(sizes)))
        words = pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(letters)
        ).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.places) + len(distinct) > self.max_words:
            self.forget()
        new = [w for w in distinct if w not in self.places]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
        entry = known[words.indices.to_numpy()]
        lengths = self.lengths[entry]
        ids = self.ids[runs_expanded(self.starts[entry], lengths)]
        return ids, np.concatenate(([0], np.cumsum(lengths)))[bounds]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin, place, fills)``: longest first, each item into the fullest bin that still takes it.

    ``open_bits`` has a bit for each free space that some bin has, so the best bin is the lowest
    bit at or above the item's size.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    spaces: dict[int, list[int]] = {}
    open_bits = 0
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        room = open_bits >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            chosen = spaces[space].pop()
            if not spaces[space]:
                open_bits &= ~(1 << space)
        else:
            space, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], places[item] = chosen, fills[chosen]
        fills[chosen] += size
        if space > size:
            spaces.setdefault(space - size, []).append(chosen)
            open_bits |= 1 << (space - size)
    return bins, places, np.array(fills, dtype=np.int64)


def _carried(fills: np.ndarray, capacity: int, nearly_full: float, carry: int) -> np.ndarray:
    """The bins that go on to the next merge."""
    out = np.zeros(len(fills), dtype=bool)
    emptiest = np.argsort(fills, kind="stable")[:carry]
    out[emptiest] = fills[emptiest] < nearly_full * capacity
    return out


def _pack_partition(tokenizer_path: str, capacity: int, nearly_full: float, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        end = np.array([END_ID], dtype="<u4")
        docs: list = []
        rows: list[tuple[int, int, int, int, int]] = []
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, bounds = tokenizer.encode(batch.column(1))
            first = len(docs)
            docs.extend(batch.column(0).to_pylist())
            for row in range(batch.num_rows):
                own = np.concatenate((ids[bounds[row] : bounds[row + 1]].astype("<u4"), end))
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((first + row, piece, start, len(part), zlib.crc32(part.tobytes())))
        if not rows:
            return
        doc, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows))
        bins, places, fills = best_fit(length, capacity)
        part = TaskContext.get().partitionId()
        carried = _carried(fills, capacity, nearly_full, carry)
        table = pa.table(
            {
                "doc_id": pa.array(docs, pa.int64()).take(pa.array(doc)),
                "piece": piece.astype(np.int32),
                "start": start,
                "length": length,
                "ids_crc32": crc,
                "bin": bins + (np.int64(part) << np.int64(32)),
                "place": places,
                "fill": fills[bins],
                "part": np.full(len(bins), part, np.int32),
                "carried": carried[bins],
            }
        )
        yield from table.to_batches(max_chunksize=20_000)

    return run


def _merge(capacity: int, nearly_full: float, carry: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # in the order of their numbers, so that a repeated run packs alike
        bins = rows.drop_duplicates("target").sort_values("target")
        old = bins["target"].to_numpy()
        into, places, fills = best_fit(bins["fill"].to_numpy(), capacity)
        lowest = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(lowest, into, old)
        at = np.searchsorted(old, rows["target"].to_numpy())
        chosen = into[at]
        return pd.DataFrame(
            {
                "bin": rows["bin"],
                "target": lowest[chosen],
                "shift": rows["shift"].to_numpy() + places[at],
                "fill": fills[chosen],
                "part": rows["part"],
                "carried": _carried(fills, capacity, nearly_full, carry)[chosen],
            }
        )

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    nearly_full: float = 0.995,
    carry: int = 64,
    fan_in: int = 8,
) -> DataFrame:
    """Places of all documents (``doc_id``, ``text``) in as few sequences as best fit finds.

    A document is its token ids and one end id; only documents over ``capacity`` ids are cut.
    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    A null or empty text is its end id alone.  A null ``doc_id`` and repeated rows are kept and
    packed like any others.  Ties in best fit go to the earlier item and the later bin.  An empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    parts = docs.select("doc_id", "text").mapInArrow(
        _pack_partition(tokenizer_path, capacity, nearly_full, carry), PIECES
    )
    pieces = stored(parts, "pieces")
    moves = (
        pieces.where("carried")
        .groupBy("bin", "fill", "part")
        .agg(F.count("*").alias("n"))
        .select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"), "fill", "part", F.lit(True).alias("carried"))
    )
    last = moves.agg(F.max("part")).first()[0]
    done: list[DataFrame] = []
    width = 1
    while last is not None and last // width > 0:
        width *= fan_in
        merged = stored(
            moves.withColumn("team", F.floor(F.col("part") / F.lit(width)))
            .groupBy("team")
            .applyInPandas(_merge(capacity, nearly_full, carry), MOVES),
            "merged",
        )
        done.append(merged.where("not carried"))
        moves = merged.where("carried")
    placed = moves
    for part in done:
        placed = placed.unionByName(part)
    placed = placed.select(F.col("bin").alias("moved_bin"), "target", "shift")
    return pieces.join(placed, pieces["bin"] == placed["moved_bin"], "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.coalesce("shift", F.lit(0)) + F.col("place")).alias("offset"),
    )


def sequences(packed: Iterable) -> dict[int, list]:
    """Pieces by sequence in order of offset, for looking at small results."""
    out: dict[int, list] = {}
    for row in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        out.setdefault(row["sequence_id"], []).append(row)
    return out

"""Which texts can share a long common subsequence, by the letter pairs they must share.

Let two texts of ``n`` and ``m`` letters become equal by at most ``d`` insertions and deletions.  With
a mark before and after, their common subsequence has ``(n + m - d) / 2 + 2`` letters and breaks into
``d + 1`` runs at most, so it holds at least ``(n + m - 3 d) / 2 + 1`` pairs of neighbouring letters
that are neighbours in both.  A text therefore can leave out its most frequent pairs, all but one of
those it must share, and still meet every partner in one of the others: these are its keys, and an
inverted index of the terms' keys finds the candidates.  The number that must be shared grows with the
length, so keys are the rare pairs, of which most words have few or none in common with a term.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How often a pair occurs among the terms is kept by a hash of the pair; a bound on what the driver sees.
FREQUENCY_SLOTS = 4096
#: Pairs are compared through this many masks of 61 bits.
MASKS = 2
#: Different pairs that a task remembers.
KNOWN_PAIRS = 1 << 18


def allowed(total: Column, cutoff: float) -> Column:
    """Most insertions and deletions for two texts of so many letters together."""
    return F.floor((1 - F.lit(cutoff)) * total + 1e-9).cast("int")


def indexable(cutoff: float) -> bool:
    """Every pair of texts that reach the cutoff must share a pair of letters."""
    return 3 * cutoff > 2


def pair_slots(seed: int = 0) -> Callable[[str], int]:
    """A function that gives a pair of letters a number, the same everywhere."""
    return lambda pair: zlib.crc32(pair.encode(), seed)


def frequencies(forms: DataFrame, form: str) -> list[int]:
    """How often pairs occur in ``forms``, by slot; ``FREQUENCY_SLOTS`` numbers reach the driver."""
    slot, slots = pair_slots(), FREQUENCY_SLOTS

    def listed(texts: pa.Array) -> pa.Array:
        marked = [f"<{t}>" for t in texts.to_pylist()]
        return pa.array([[slot(p) % slots for p in {m[i : i + 2] for i in range(len(m) - 1)}] for m in marked], pa.list_(pa.int32()))

    each = forms.select(F.explode(F.arrow_udf(listed, "array<int>")(F.col(form))).alias("s"))
    table = [0] * FREQUENCY_SLOTS
    for row in each.groupBy("s").agg(F.count("*").alias("n")).collect():
        table[row["s"]] = row["n"]
    return table


def must_share(size: Column, other: Column, cutoff: float) -> Column:
    """Pairs, counted as often as they occur, that texts of these lengths share if they reach the cutoff."""
    total = size + other
    return F.floor((total - 3 * allowed(total, cutoff)) / 2).cast("int") + 1


def pair_coder() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of the code points of first and second letters that gives each pair one of 2^16 numbers."""
    one, other, bits = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(16)
    return lambda first, second: (first.astype(np.uint32) * one + second.astype(np.uint32) * other) >> bits


class PairGate:
    """Which runs of words can reach the cutoff with one of the forms of as many words, told by letter pairs.

    Of a run's pairs, counted as often as they occur, so many at least are among those of all forms as it
    must share with one of them, whose length allows it.  No run that has a partner is lost.
    """

    def __init__(self, forms: DataFrame, form: str, cutoff: float):
        coder = pair_coder()

        def listed(texts: pa.Array) -> pa.Array:
            marked = [np.frombuffer(f"<{t}>".encode("utf-32-le"), "<u4") for t in texts.to_pylist()]
            return pa.array([coder(m[:-1], m[1:]).tolist() for m in marked], pa.list_(pa.int32()))

        pairs = forms.select("words", F.explode(F.arrow_udf(listed, "array<int>")(F.col(form))).alias("p")).distinct()
        #: By the number of words which pairs their forms have, and how many of them a run of each length needs.
        self.tables: dict[int, np.ndarray] = {}
        for r in pairs.collect():
            self.tables.setdefault(r["words"], np.zeros(1 << 16, np.bool_))[r["p"]] = True
        lengths: dict[int, list[int]] = {}
        for r in forms.select("words", F.length(form).alias("n")).distinct().collect():
            lengths.setdefault(r["words"], []).append(r["n"])
        never = np.iinfo(np.int32).max

        def needed(size: int, others: list[int]) -> int:
            edits = {m: math.floor((1 - cutoff) * (size + m) + 1e-9) for m in others}
            return min((math.floor((size + m - 3 * d) / 2) + 1 for m, d in edits.items() if abs(size - m) <= d), default=never)

        longest = {words: math.ceil(max(of) * (2 - cutoff) / cutoff) + 1 for words, of in lengths.items()}
        self.needed = {words: np.array([*[needed(n, of) for n in range(longest[words] + 1)], never], np.int64) for words, of in lengths.items()}


def described(df: DataFrame, text: str, often: list[int], cutoff: float) -> DataFrame:
    """``df`` with ``length``, ``n_pairs``, masks of all letter pairs, and the ``keys`` to be found by.

    Pairs that no term has are no keys: they count among those left over, and find nothing.
    """
    slot, seeds, known_pairs = pair_slots(), [pair_slots(k + 1) for k in range(MASKS)], KNOWN_PAIRS
    indexed, slots = indexable(cutoff), FREQUENCY_SLOTS
    known: dict[str, tuple[int, ...]] = {}

    def least_shared(size: int, pairs: int) -> int:
        """Different pairs that a text shares with whatever partner it has; repeated ones may be one pair."""
        total = size + math.ceil(size * cutoff / (2 - cutoff) - 1e-9)
        always = math.floor(total * ((3 * cutoff - 2) / 2) + 1e-9) + 1
        return max(1, always - (size + 1 - pairs))

    def listed(texts: pa.Array) -> pa.Array:
        if len(known) > known_pairs:
            known.clear()
        rows = []
        for t in texts.to_pylist():
            marked, placed, masks = f"<{t}>", [], [0] * len(seeds)
            pairs = {marked[i : i + 2] for i in range(len(marked) - 1)}
            for p in pairs:
                of = known.get(p)
                if of is None:
                    of = known[p] = (often[slot(p) % slots], *[1 << (seed(p) % 61) for seed in seeds])
                placed.append((of[0], p))
                for k, bit in enumerate(of[1:]):
                    masks[k] |= bit
            placed.sort()
            prefix = placed[: len(pairs) - least_shared(len(t), len(pairs)) + 1]
            rows.append((len(t), len(pairs), *masks, [p for n, p in prefix if n > 0] if indexed else [""]))
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["length", "n_pairs", *[f"mask{k}" for k in range(MASKS)], "keys"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * MASKS, pa.list_(pa.string())]
    returns = "struct<length:int,n_pairs:int," + "".join(f"mask{k}:bigint," for k in range(MASKS)) + "keys:array<string>>"
    found = df.withColumn("_described", F.arrow_udf(listed, returns)(F.col(text)))
    return found.select(*df.columns, *[F.col(f"_described.{n}").alias(n) for n in names])


def can_match(cutoff: float, other: str) -> Column:
    """Lengths and shared pairs allow the cutoff; the partner's columns have the prefix ``other``."""
    n, m = F.col("length"), F.col(f"{other}length")
    near = F.abs(n - m) <= allowed(n + m, cutoff)
    # Different pairs shared are at least those that must be, less what may be one pair repeated.
    shared = F.greatest(
        must_share(n, m, cutoff) - (n + 1 - F.col("n_pairs")), must_share(n, m, cutoff) - (m + 1 - F.col(f"{other}n_pairs"))
    )
    apart = F.col("n_pairs") + F.col(f"{other}n_pairs") - 2 * F.greatest(F.lit(0), shared)
    differ = sum((F.bit_count(F.col(f"mask{k}").bitwiseXOR(F.col(f"{other}mask{k}"))) for k in range(1, MASKS)),
                 F.bit_count(F.col("mask0").bitwiseXOR(F.col(f"{other}mask0"))))
    # A pair that only one of them has sets one bit in each mask.
    return near & (differ <= MASKS * apart)

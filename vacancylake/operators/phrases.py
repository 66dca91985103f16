"""Runs of words of a text as rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.operators.gram_index import PairGate, pair_coder

#: Bits of a ``PhraseGate``: so many for a form, a power of two between these bounds.  They reach the
#: driver and every task, at most 16 MB.
FORM_BITS = 16
GATE_BITS = (1 << 18, 1 << 27)
#: Bits that a form sets.
PROBES = 4
#: Different words whose hashes a task keeps.
KNOWN_WORDS = 1 << 18
#: Different runs of words that a task remembers, and texts that are looked at together.
KNOWN_RUNS, TEXTS_AT_ONCE = 1 << 19, 256
#: The hash of a run is a polynomial in this odd number; its inverse takes a place's power out.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def run_slots(bits: int) -> Callable[[list[str]], Callable[[int], list[np.ndarray]]]:
    """For the words of a text a function that gives the bits of its runs of so many words, all at the same cost.

    All it needs is inside, since it is sent by value and executors need not be able to import it.
    """

    def powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def code(word: str) -> int:
        coded = word.encode()
        return zlib.crc32(coded) << 32 | zlib.crc32(coded[::-1], 0x5BD1E995)

    def mixed(value: np.ndarray) -> np.ndarray:
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return value ^ (value >> np.uint64(32))

    known: dict[str, int] = {}
    up, down = powers(BASE, 1024), powers(INVERSE, 1024)

    def of(words: list[str]) -> Callable[[int], list[np.ndarray]]:
        nonlocal up, down
        size = len(words)
        if size > len(up):
            up, down = powers(BASE, 2 * size), powers(INVERSE, 2 * size)
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = code(word)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(mixed(np.fromiter(map(known.__getitem__, words), np.uint64, size)) * up[:size], out=sums[1:])

        def slots(count: int) -> list[np.ndarray]:
            places = size + 1 - count
            hashes = mixed((sums[count:] - sums[:places]) * down[:places] + np.uint64(count))
            step = (hashes >> np.uint64(32)) | np.uint64(1)
            return [((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]

        return slots

    return of


class PhraseGate:
    """Which runs of words can be one of a dictionary's forms, told by their hashes.

    Each form sets some bits of a Bloom filter that grows with the dictionary.  The hash of a run follows
    from two sums, so a place of a text costs a look for each word count, the same for a form of two words
    and one of five hundred; the run itself is put together only where all bits are set.  Of other
    runs about one in 400 gets through, more where the dictionary is beyond the largest filter; none is lost.
    """

    def __init__(self, forms: DataFrame, form: str = "form"):
        sizes = forms.groupBy(F.size(F.split(form, " ")).alias("words")).count().collect()
        #: Numbers of words that forms have.
        self.counts = sorted(r["words"] for r in sizes)
        self.bits, most = GATE_BITS
        while self.bits < min(most, FORM_BITS * sum(r["count"] for r in sizes)):
            self.bits *= 2
        slots_of = run_slots(self.bits)

        def slots(texts: pa.Array) -> pa.Array:
            split = [t.split(" ") for t in texts.to_pylist()]
            return pa.array([[int(s[0]) for s in slots_of(w)(len(w))] for w in split], pa.list_(pa.int64()))

        set_ = forms.select(F.explode(F.arrow_udf(slots, "array<bigint>")(F.col(form))).alias("s")).groupBy(
            F.floor(F.col("s") / 64).alias("at")
        )
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))
        found = set_.agg(F.bit_or(one).alias("bits")).toArrow()
        table = np.zeros(self.bits // 64, np.int64)
        table[found["at"].to_numpy()] = found["bits"].to_numpy()
        self.table = table.view(np.uint64)


def _gated(counts: list[int], gate: PhraseGate, places: bool) -> Callable[[Column], Column]:
    """Structs of word count, phrase and place, of runs that ``gate`` lets through; each run once, unless places count."""
    table, slots_of = gate.table, run_slots(gate.bits)

    def run(texts: pa.Array) -> pa.Array:
        lengths = [0]
        words_of, phrase, at = [], [], []
        for t in texts.to_pylist():
            words = [] if t is None else t.split(" ")
            slots = slots_of(words)
            for n in counts:
                if n > len(words):
                    break
                here = np.arange(len(words) + 1 - n)
                for slot in slots(n):
                    here = here[(table[slot[here] >> 6] >> (slot[here] & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    if not len(here):
                        break
                runs = [(" ".join(words[i : i + n]), i) for i in here.tolist()]
                if not places:
                    runs = list({p: (p, i) for p, i in reversed(runs)}.values())
                words_of += [n] * len(runs)
                phrase += [p for p, _ in runs]
                at += [i for _, i in runs]
            lengths.append(len(at))
        rows = pa.StructArray.from_arrays(
            [pa.array(words_of, pa.int32()), pa.array(phrase, pa.string()), pa.array(at, pa.int32())], ["words", "phrase", "at"]
        )
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), rows)

    return F.arrow_udf(run, "array<struct<words:int,phrase:string,at:int>>")


def phrases(
    forms: DataFrame, key: str, form: str, counts: Iterable[int], gate: PhraseGate | None = None, *, places: bool = False
) -> DataFrame:
    """``(key, words, phrase)`` for every run of as many words as ``counts`` names and ``gate`` lets through.

    With ``places`` also ``at``, the number of the run's first word in the text, from 0; without them a
    run that ``gate`` lets through is listed once for its text.

    ``form`` went through ``functions.text.match_form``.  The runs of a text are one array until
    they become rows, so a long text is not copied along with each of its words.
    """
    columns = ["s.words", "s.phrase", *(["s.at"] if places else [])]
    if gate:
        runs = _gated(sorted(set(counts)), gate, places)(F.col(form))
        return forms.select(key, F.explode(runs).alias("s")).select(key, *columns)
    words = forms.select(key, F.split(F.col(form), " ").alias("w"))
    numbers = F.array(*[F.lit(n) for n in sorted(counts)]).cast("array<int>")
    runs = F.transform(
        F.filter(numbers, lambda n: n <= F.size("w")),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.size("w") - n + 1),
            lambda at: F.struct(n.alias("words"), F.array_join(F.slice("w", at, n), " ").alias("phrase"), (at - 1).alias("at")),
        ),
    )
    return words.select(key, F.explode(F.flatten(runs)).alias("s")).select(key, *columns)


def distinct_phrases(forms: DataFrame, form: str, gate: PairGate) -> DataFrame:
    """``(words, phrase)``: the runs of words that ``gate`` lets through, each once for a task that remembers it.

    The pairs of letters of many texts are looked up at once, and sums up to each letter tell how many of a
    run's pairs its partners have, so only runs that may have a partner are put together.
    """
    coder, tables, needed = pair_coder(), gate.tables, gate.needed
    known_runs, at_once = KNOWN_RUNS, TEXTS_AT_ONCE
    left, right = (np.array([ord(mark)], np.uint32) for mark in "<>")

    def found(texts: list[str], seen: set[str]) -> Iterator[tuple[int, str]]:
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        inside = np.zeros(len(points) + 1, np.bool_)
        np.logical_and(points != 32, points != 10, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        text_of = np.cumsum(points == 10)[begins]
        codes = coder(points[:-1], points[1:])
        opening, closing = coder(left, points[begins]), coder(points[ends - 1], right)
        for n, table in tables.items():
            many = len(begins) - n + 1
            if many <= 0:
                continue
            first, last = begins[:many], ends[n - 1 :]
            upto = np.concatenate(([0], np.cumsum(table[codes], dtype=np.int32)))
            shared = upto[last - 1] - upto[first] + table[opening[:many]] + table[closing[n - 1 :]]
            need = needed[n][np.minimum(last - first, len(needed[n]) - 1)]
            for i in np.flatnonzero((shared >= need) & (text_of[:many] == text_of[n - 1 :])).tolist():
                phrase = joined[first[i] : last[i]]
                if phrase not in seen:
                    seen.add(phrase)
                    yield n, phrase

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for first in range(0, len(texts), at_once):
                if len(seen) > known_runs:
                    seen.clear()
                rows = list(found(texts[first : first + at_once], seen))
                words, runs = [n for n, _ in rows], [p for _, p in rows]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(runs, pa.string())], ["words", "phrase"])

    return forms.select(form).mapInArrow(listed, "words int, phrase string")

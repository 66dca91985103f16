"""Hashed maximum-entropy language model (operator 3).

A word's probability is that of its class given the words before it, times that of the word in its
class.  The most frequent words are classes of their own, all others are classed by a hash of their
last letters, so a word that was never seen has a class too.  The class follows a softmax over
hashed features of the history (the word before, the two words before, the word before those as a
skip feature, and the classes of three words); words in a class follow their smoothed counts.

1. Word counts: every chunk of documents sends its different words once; counts come back to the
   chunks that have the word, so no task or driver holds the vocabulary.
2. Features are counted with the class that followed, which gives the first weights.
3. Gradient rounds: tasks sum the gradient of their documents under the current weights, the class
   that the model expects being drawn by a hash; the sums are added up, and each feature takes a step
   scaled by how often it fired.  The rounds go through disjoint parts of the documents and together
   through all of them.
4. Chunks are scored in slices of sparse feature rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import mixed, slices, text_bytes, word_hashes, word_spans
from vacancylake.llm.language import bucket_of
from vacancylake.llm.linear import row_sums
from vacancylake.llm.tables import stored

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 16 << 20
CLASSES = 48
OWN_CLASS = 16
BITS = 15
FEATURES = 4
#: Tokens whose probabilities are in memory at once.
ROWS = 8192
#: Weights stay within these bounds.
BOUND = 12.0
#: What a step is damped by: features that fire less than this hardly move.
DAMPING = 20.0
#: Rows of the weights that travel together when gradients are added up.
BLOCK_ROWS = 1 << 10
PARTS, HELD_OUT = 7, 2
#: Parts of the documents that each gradient round learns from.
ROUNDS = ((0, 1), (3, 4), (5, 6))

END = np.int64(0x656E64)
#: What stands before the first word.
START = np.uint64(0x7374617274)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, endings, bounds)``: hash and ending class of each token, each text closed by an end.

    ASCII letters are compared in lower case.
    """
    data, offsets = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    starts, ends, bounds = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    letters = np.zeros(len(starts), dtype=np.uint64)
    for back in (3, 2, 1):
        at = ends - back
        letters = (letters << np.uint64(8)) | np.where(at >= starts, data[np.maximum(at, 0)] if len(data) else 0, 0).astype(np.uint64)
    ending = (mixed(letters + np.uint64(11)) % np.uint64(CLASSES - OWN_CLASS)).astype(np.int64)
    at = bounds[1:]
    words = np.insert(hashes.view(np.int64), at, END)
    endings = np.insert(ending, at, 0)
    return words, endings, bounds + np.arange(len(bounds))


@dataclass
class Classes:
    """Words with a class of their own, in order of their hashes."""

    words: np.ndarray
    numbers: np.ndarray

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = OWN_CLASS + endings
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.numbers[at], out)
        return out


def _features(words: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Buckets of the features of each token's history, one column per kind."""
    n = len(words)

    def before(values: np.ndarray, back: int, outside: np.uint64) -> np.ndarray:
        out = np.full(n, outside, dtype=np.uint64)
        out[back:] = values[: n - back] if back < n else values[:0]
        for k in range(back):
            at = bounds[:-1] + k
            out[at[at < bounds[1:]]] = outside + np.uint64(k)
        return out

    own = words.view(np.uint64)
    kinds = classes.astype(np.uint64)
    one, two = before(own, 1, START), before(own, 2, START)
    class_key = (
        before(kinds, 1, np.uint64(CLASSES)) * np.uint64(4096)
        + before(kinds, 2, np.uint64(CLASSES)) * np.uint64(64)
        + before(kinds, 3, np.uint64(CLASSES))
    )
    keys = (one + np.uint64(1), mixed(two) + one * np.uint64(3), two + np.uint64(5), class_key + np.uint64(7))
    shift = np.uint64(64 - BITS)
    return np.column_stack([(mixed(mixed(k) + np.uint64(n)) >> shift).astype(np.int64) for n, k in enumerate(keys)])


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, word, ending, n)``: the different words of each chunk, and how often learned rows have them."""
    for batch in slices(batches, "text", CHUNK_BYTES):
        chunk = batch.column(0).to_numpy()
        learned = ~batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(chunk, kind="stable")
        batch = batch.take(pa.array(order))
        chunk, learned = chunk[order], learned[order]
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(chunk))):
            found = []
            own = pa.RecordBatch.from_arrays([pa.array(learned[a:b]), batch.column(2).slice(a, b - a)], ["learned", "text"])
            for part in slices(iter([own]), "text", SLICE_BYTES):
                words, endings, bounds = tokens(part.column(1))
                counts = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(bounds))
                found.append((words, endings.astype(np.int8), counts))
            words, endings, counted = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(words)
            first = np.flatnonzero(np.diff(words[order], prepend=words[order][0] - 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": np.full(len(first), chunk[a]),
                    "word": words[order][first],
                    "ending": endings[order][first].astype(np.int32),
                    "n": np.add.reduceat(counted[order].astype(np.int64), first),
                }
            )


def _blocks(table: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table that were touched, in blocks."""
    touched = np.flatnonzero(table.any(axis=1).reshape(-1, rows).any(axis=1))
    yield pa.RecordBatch.from_pydict(
        {
            "block": touched.astype(np.int32),
            "sums": pa.array([table[b * rows : (b + 1) * rows].astype(np.float32).tobytes() for b in touched], pa.binary()),
        }
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block over all tasks; blocks stream in, one sum of each is held."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.frombuffer(part, np.float32)
            sums[block] = sums[block] + values if block in sums else values.astype(np.float64)
    for block, values in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"block": np.array([block], np.int32), "sums": pa.array([values.astype(np.float32).tobytes()], pa.binary())}
        )


def _total(texts: DataFrame, function) -> np.ndarray:
    """The table that ``function`` sums up, added over all tasks; its size is that of the model."""
    schema = "block int, sums binary"
    added = texts.mapInArrow(function, schema).repartition(1 << BITS - 10, "block").mapInArrow(_added, schema)
    out = np.zeros((1 << BITS, CLASSES))
    rows = added.collect()
    texts.sparkSession.sparkContext._jvm.System.gc()  # lets the sums' shuffle files go
    for row in rows:
        out[row["block"] * BLOCK_ROWS : (row["block"] + 1) * BLOCK_ROWS] = np.frombuffer(row["sums"], np.float32).reshape(
            -1, CLASSES
        )
    return out


def _counted(classes: Classes):
    """How often each class followed each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) * CLASSES, dtype=np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            words, endings, bounds = tokens(batch.column(0))
            kinds = classes.of(words, endings)
            for feature in _features(words, kinds, bounds).T:
                np.add.at(table, feature * CLASSES + kinds, 1)
        yield from _blocks(table.reshape(-1, CLASSES), BLOCK_ROWS)

    return run


@dataclass
class Model:
    classes: Classes
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)

    def chances(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, a row per token; weights are bounded, so no exponent overflows."""
        odds = self.weights[features[:, 0]] + self.bias
        for column in range(1, FEATURES):
            odds += self.weights[features[:, column]]
        np.exp(odds, out=odds)
        odds *= (1 / odds.sum(axis=1))[:, None]
        return odds


def _gradient(model: Model):
    """Sums of wanted less expected classes, for each feature.

    What the model expects at a token is one class, drawn from its probabilities by a hash of the
    token and its history: an unbiased estimate that costs two numbers for each feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) * CLASSES, dtype=np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            words, endings, bounds = tokens(batch.column(0))
            kinds = model.classes.of(words, endings)
            features = _features(words, kinds, bounds)
            place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
            key = words.view(np.uint64) + features[:, 1].astype(np.uint64) + mixed(place.astype(np.uint64))
            share = (mixed(key) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            for at in range(0, len(words), ROWS):
                some = features[at : at + ROWS]
                passed = np.cumsum(model.chances(some), axis=1) < share[at : at + ROWS, None]
                drawn = np.minimum(passed.sum(axis=1), CLASSES - 1)
                for feature in some.T * CLASSES:
                    np.add.at(table, feature + kinds[at : at + ROWS], 1)
                    np.subtract.at(table, feature + drawn, 1)
        yield from _blocks(table.reshape(-1, CLASSES), BLOCK_ROWS)

    return run


def first_weights(counts: np.ndarray, prior: np.ndarray, smoothing: float = 5.0, share: float = 0.3) -> np.ndarray:
    """Logarithms of how much more often a class follows a feature; kinds of features share the evidence."""
    total = counts.sum(axis=1, keepdims=True)
    likely = (counts + smoothing * prior) / (total + smoothing)
    return np.clip(share * np.log(likely / prior), -BOUND, BOUND).astype(np.float32)


def train(docs: DataFrame, frequent: list[int], class_tokens: np.ndarray) -> Model:
    """A model of the rows of ``docs`` (text, part) for classes with these token counts."""
    order = np.argsort(np.array(frequent, dtype=np.int64))
    classes = Classes(np.array(frequent, dtype=np.int64)[order], order.astype(np.int64))
    prior = (class_tokens + 1) / (class_tokens + 1).sum()
    counts = _total(docs.select("text"), _counted(classes))
    model = Model(classes, first_weights(counts, prior), np.log(prior).astype(np.float32))
    fired = counts.sum(axis=1, keepdims=True)
    for parts in ROUNDS:
        gradient = _total(docs.where(F.col("part").isin(*parts)).select("text"), _gradient(model))
        # a third of the firings in each round; half of the features' number bounds the curvature
        step = 1 / (FEATURES / 2 * fired / len(ROUNDS) + DAMPING)
        model.weights = np.clip(model.weights + step * gradient, -BOUND, BOUND).astype(np.float32)
    return model


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scorer(model: Model, class_tokens: np.ndarray, class_words: np.ndarray):
    total, distinct = int(class_tokens.sum()), int(class_words.sum())
    in_class = np.log10(class_tokens + class_words + 1)

    def run(docs: pd.DataFrame, lexicon: pd.DataFrame) -> pd.DataFrame:
        lexicon = lexicon.sort_values("word")
        known, counts = lexicon["word"].to_numpy(), lexicon["c"].to_numpy()
        table = pa.RecordBatch.from_pydict({"text": pa.array(docs["text"], pa.large_string())})
        parts = []
        for batch in slices(iter([table]), "text", SLICE_BYTES):
            words, endings, bounds = tokens(batch.column(0))
            count = counts[np.searchsorted(known, words)]
            kinds = model.classes.of(words, endings)
            features, of_class = _features(words, kinds, bounds), np.zeros(len(words))
            for at in range(0, len(words), ROWS):
                chances = model.chances(features[at : at + ROWS])
                of_class[at : at + ROWS] = chances[np.arange(len(chances)), kinds[at : at + ROWS]]
            of_class = np.log10(np.maximum(of_class, 1e-30))
            of_word = np.log10(count + 1.0)
            n = np.diff(bounds)
            parts.append(
                pd.DataFrame(
                    {
                        "n_tokens": n,
                        "n_known": row_sums(count > 0, bounds).astype(np.int64),
                        "base_score": row_sums(of_word, bounds) - n * np.log10(total + distinct + 1),
                        "score": row_sums(of_class + of_word - in_class[kinds], bounds),
                    }
                )
            )
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["n_tokens", "n_known", "base_score", "score"])
        out["doc_id"] = pd.array(docs["doc_id"], dtype="Int64")
        out["held_out"] = docs["held_out"].to_numpy()
        out["train_tokens"] = total
        return out[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learns from the rows whose CRC-32 of the id as text, modulo 7, is not 2.  Scores are base-10
    logarithms of the probability of the whole text; ``base_score`` is that of single words with one
    added to each count.  Words are told apart by 64-bit hashes.

    A null or empty text is its end token alone.  A null ``doc_id`` counts as an empty text.
    Repeated rows are learned from as often as they occur.  Without learned rows all words are
    unknown.  An empty table gives no rows.  Other columns are not read.
    """
    part = bucket_of("doc_id", PARTS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(max(1, -(-size // CHUNK_BYTES))))
    dealt = rows.select("doc_id", (F.col("part") == HELD_OUT).alias("held_out"), "text", chunk.alias("chunk"))
    # words of one chunk come together before they are counted
    lexicon = stored(
        dealt.repartition("chunk")
        .select("chunk", "held_out", "text")
        .mapInArrow(_lexicon, "chunk long, word long, ending int, n long")
        .groupBy("chunk", "word", "ending")
        .agg(F.sum("n").alias("n")),
        "lexicon",
    )
    counts = stored(lexicon.groupBy("word", "ending").agg(F.sum("n").alias("c")), "counts")
    top = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(OWN_CLASS).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where("c > 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_tokens[OWN_CLASS + r["ending"]], class_words[OWN_CLASS + r["ending"]] = r["c"], r["n"]
    for number, r in enumerate(top):
        class_tokens[number], class_words[number] = r["c"], 1
        class_tokens[OWN_CLASS + r["ending"]] -= r["c"]
        class_words[OWN_CLASS + r["ending"]] -= 1
    model = train(rows.where(F.col("part") != HELD_OUT), [r["word"] for r in top], class_tokens)
    answers = lexicon.select("chunk", "word").join(counts.select("word", "c"), "word")
    return (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(_scorer(model, class_tokens, class_words), RESULT)
    )

"""Language identification by sparse multinomial logistic regression (operator 10).

Features are TF-IDF weights of hashed character n-grams.  The document frequencies come from all
rows to learn from; the regression is fitted by follow-the-regularised-leader with elastic net on
a bounded sample of them, and a temperature, fitted on a part of the sample that the regression
did not see, makes its probabilities honest.  Scoring is a table look-up and a sum per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import slices
from vacancylake.llm.linear import (
    code_points,
    fit,
    fitted_temperature,
    gram_buckets,
    letters,
    row_sums,
    softmax,
    sparse_rows,
)

ORDERS = (1, 2, 3)
BITS = 16
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    #: One table per language: IDF times weight for each bucket, 0 for no bucket.
    tables: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0


def bucket_of(column: str | Column, parts: int) -> Column:
    """CRC-32 of the value as text, modulo ``parts``; a null counts as an empty text."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(""))
    return F.crc32(text.cast("binary")) % parts


def _grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets by order, offsets, and whether each row has a letter; other signs become spaces."""
    codes, offsets = code_points(column, lower=True)
    is_letter = letters(codes)
    has_letter = row_sums(is_letter, offsets) > 0 if len(codes) else np.zeros(len(offsets) - 1, dtype=bool)
    codes = np.where(is_letter, codes, np.uint32(32)).astype(np.uint64)
    return [gram_buckets(codes, offsets, n, BITS) for n in ORDERS], offsets, has_letter


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, documents)``; bucket -1 counts the documents themselves."""
    found = np.zeros((1 << BITS) + 1, dtype=np.int64)
    seen = np.zeros((1 << BITS) + 1, dtype=bool)
    documents = 0
    for batch in slices(batches, "text", SLICE_BYTES):
        grams, offsets, has_letter = _grams(batch.column(0))
        for row in np.flatnonzero(has_letter):
            for buckets in grams:
                seen[buckets[offsets[row] : offsets[row + 1]]] = True
            index = np.flatnonzero(seen)
            found[index] += 1
            seen[index] = False
            documents += 1
    index = np.flatnonzero(found[:-1])
    if documents:
        yield pa.RecordBatch.from_pydict(
            {"bucket": np.append(index, -1).astype(np.int32), "documents": np.append(found[index], documents)}
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        grams, offsets, has_letter = _grams(batch.column(0))
        rows = list(sparse_rows(grams, [offsets] * len(grams), BITS))
        keep = np.flatnonzero(has_letter)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": batch.column(1).take(pa.array(keep)),
                "share": batch.column(2).take(pa.array(keep)),
                "buckets": pa.array([rows[r][0].tobytes() for r in keep], pa.binary()),
                "counts": pa.array([rows[r][1].astype(np.int32).tobytes() for r in keep], pa.binary()),
            }
        )


def train(
    rows: DataFrame, rows_per_language: int = 800, calibration_part: float = 0.25, epochs: int = 3
) -> LanguageModel:
    """A model learned from ``text, lang``; rows without either are left out.

    The sample that the regression is fitted on has about ``rows_per_language`` documents of each
    language, chosen by a hash, and never more than twice as many in all.  The driver sees these,
    as counts of n-grams, and ``2 ** BITS`` document frequencies.
    """
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros(0))
    frequency = {
        r["bucket"]: r["n"]
        for r in rows.select("text")
        .mapInArrow(_document_frequencies, "bucket int, documents long")
        .groupBy("bucket")
        .agg(F.sum("documents").alias("n"))
        .collect()
    }
    documents = frequency.pop(-1, 0)
    found = np.zeros(1 << BITS)
    found[list(frequency)] = list(frequency.values())
    idf = np.log((1 + documents) / (1 + found)) + 1

    share = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts = F.lit(0.0)
    for lang, n in sizes.items():
        parts = F.when(F.col("lang") == lang, min(1.0, rows_per_language / n)).otherwise(parts)
    sample = (
        rows.withColumn("share", share / parts)
        .where(share < parts)
        .orderBy("share", "lang", "text")
        .limit(2 * rows_per_language * len(sizes))
        .mapInArrow(_features, "lang string, share double, buckets binary, counts binary")
        .collect()
    )
    sample.sort(key=lambda r: (r["share"], r["lang"], r["buckets"]))
    languages = sorted(sizes)
    vectors = []
    for r in sample:
        index = np.frombuffer(r["buckets"], np.int32)
        counts = np.frombuffer(r["counts"], np.int32)
        vectors.append((index, counts / counts.sum() * idf[index] * SCALE))
    targets = np.array([languages.index(r["lang"]) for r in sample], dtype=np.int64)
    aside = np.array([r["share"] >= 1 - calibration_part for r in sample], dtype=bool)
    learn = [v for v, out in zip(vectors, aside) if not out]
    weights = fit(learn, targets[~aside], 1 << BITS, len(languages), epochs)
    checked = [v for v, out in zip(vectors, aside) if out]
    logits = np.array([v @ weights[i] + weights[-1] for i, v in checked]).reshape(len(checked), len(languages))
    tables = np.zeros((len(languages), (1 << BITS) + 1), dtype=np.float32)
    tables[:, :-1] = (weights[:-1] * idf[:, None] * SCALE).T
    return LanguageModel(languages, tables, weights[-1], fitted_temperature(logits, targets[aside]))


#: Shares of n-grams are small; the optimiser likes values near 1.
SCALE = 30.0


def guesses(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and probability of each text."""
    grams, offsets, has_letter = _grams(column)
    rows = len(column)
    logits, total = np.zeros((rows, len(model.languages))), np.zeros(rows)
    for buckets in grams:
        total += row_sums(buckets < 1 << BITS, offsets)
        for k, table in enumerate(model.tables):
            logits[:, k] += row_sums(table[buckets], offsets)
    logits = logits / np.maximum(total, 1)[:, None] + model.bias
    known = has_letter & bool(model.languages)
    names, score = np.full(rows, UNDETERMINED, dtype=object), np.zeros(rows)
    if known.any():
        chances = softmax(logits[known] / model.temperature)
        names[known] = np.array(model.languages, dtype=object)[chances.argmax(axis=1)]
        score[known] = chances.max(axis=1)
    return names, score


def _scorer(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            names, score = guesses(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of whole texts, one row for each row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, lang_pred string, score double")


def in_languages(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with a probability of ``least``.

    Null texts and those without letters have no language and go.  Equal texts share their fate, texts of
    any length are read whole, and other columns aren't looked at.  An empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            names, score = guesses(model, batch.column(at))
            out = batch.filter(pa.array((names != UNDETERMINED) & (score >= least)))
            yield out.set_column(at, "text", out.column(at).cast(pa.string()))

    return docs.mapInArrow(run, docs.schema)


def learned_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` to learn from: three of four by the CRC-32 of the id."""
    return docs.where(bucket_of("doc_id", 4) != 2)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learned from the rows not held out.

    ``lang_pred`` is a language of the rows to learn from, or ``und`` with score 0 where the text
    is null or has no letter, or where there is nothing to learn from.  A null ``doc_id`` counts as
    an empty text; repeated rows get equal answers; ties go to the first language by name.  An
    empty table gives no rows.  Only ``doc_id``, ``text`` and ``lang`` are read, the latter for
    learning alone.
    """
    model = train(learned_rows(docs))
    return predict(docs, model).select(
        "doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )

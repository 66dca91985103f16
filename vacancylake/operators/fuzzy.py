"""Fuzzy matching of dictionary terms against texts.

Spelling is compared once per distinct word or phrase of the whole table, not per occurrence.
Phrases find the terms they can match through an inverted index of letter pairs (``gram_index``):
a common subsequence long enough for the threshold needs a number of shared pairs, so rare ones
suffice as keys, and counts of pairs that differ, read off bit masks, discard most that meet.  A
bounded edit distance discards nearly all others, and the exact score is computed for the rest.
All of it are column expressions, and all terms take part, however short.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.functions.text import match_form
from vacancylake.operators.gram_index import MASKS, PairGate, allowed, can_match, described, frequencies
from vacancylake.operators.phrases import PhraseGate, distinct_phrases, phrases
from vacancylake.schemas import TERM
from vacancylake.session import materialize
from vacancylake.sources.vocabulary import Term

THRESHOLD = 0.8
SCORERS = ("ratio", "levenshtein")
#: Longest phrase whose places fit in the bits of a long.
MASK_BITS = 62


def _letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def common_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two texts that are not empty.

    Up to ``MASK_BITS`` letters on the right, all places are updated at once: a bit stays set
    where the common subsequence does not grow.  Longer texts go letter by letter.
    """
    size, letters = F.length(right), _letters(right)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(size, F.lit(MASK_BITS))) - 1

    def places(letter: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        return F.aggregate(
            F.sequence(F.lit(0), size - 1),
            F.lit(0).cast("long"),
            lambda mask, i: mask.bitwiseOR(F.when(F.get(letters, i) == letter, bit(i)).otherwise(F.lit(0).cast("long"))),
        )

    def grown(open_: Column, mask: Column) -> Column:
        hit = open_.bitwiseAND(mask)
        return (open_ + hit).bitwiseOR(open_.bitwiseAND(F.bitwise_not(mask))).bitwiseAND(full)

    short = size - F.bit_count(F.aggregate(F.transform(_letters(left), places), full, grown))

    def row(before: Column, letter: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), size),
            F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(
                    F.when(F.get(letters, j - 1) == letter, F.get(before, j - 1) + 1).otherwise(
                        F.greatest(F.get(before, j), F.get(done, j - 1))
                    )
                ),
            ),
        )

    nothing = F.array_repeat(F.lit(0), size + 1)
    long = F.get(F.aggregate(_letters(left), nothing, row), size)
    return F.when(size <= MASK_BITS, short).otherwise(long)


def ratio(left: str, right: str) -> Column:
    """Twice the common subsequence over both lengths, in whole percent."""
    total = F.length(left) + F.length(right)
    return F.round(F.lit(200.0) * common_length(F.col(left), F.col(right)) / total) / 100.0


def term_table(df: DataFrame, terms: DataFrame | Iterable[Term]) -> DataFrame:
    """Terms given as rows of ``schemas.TERM`` or in a Python collection, as a table."""
    return terms if isinstance(terms, DataFrame) else df.sparkSession.createDataFrame(list(terms), TERM)


def _named(terms: DataFrame) -> DataFrame:
    """Term names with the form they are compared in."""
    named = terms.where("alias_pos = 0").withColumn("form", match_form(F.col("alias"))).where("form != ''")
    return named.select("dict", F.col("term").alias("keyword"), "category", "subcategory", "weight", "form").distinct()


def candidates(vocabulary: DataFrame, forms: DataFrame, cutoff: float) -> DataFrame:
    """``(words, phrase, form)``: the phrases and forms of as many words that may reach the cutoff.

    ``vocabulary``: different ``words, phrase``; ``forms``: different ``words, form``.  Phrases meet
    forms through the keys of ``gram_index``; what lengths and shared letter pairs rule out is gone.
    """
    often = frequencies(forms, "form")
    columns = ["words", "length", "n_pairs", *[f"mask{k}" for k in range(MASKS)]]
    # Written, so that the planner knows the sizes and nothing is described once for each key.
    left = materialize(described(vocabulary, "phrase", often, cutoff).select("phrase", *columns, "keys"), "phrases")
    right = materialize(described(forms, "form", often, cutoff).select("form", *[F.col(c).alias(f"f_{c}") for c in columns], F.explode("keys").alias("f_key")), "forms")
    left = left.withColumn("key", F.explode("keys")).drop("keys")
    met = left.join(right, (F.col("key") == F.col("f_key")) & (F.col("words") == F.col("f_words")) & can_match(cutoff, "f_"))
    return met.select("words", "phrase", "form").distinct()


def fuzzy_matches(
    df: DataFrame,
    key: str,
    text: str,
    terms: DataFrame | Iterable[Term],
    *,
    threshold: float = THRESHOLD,
    scorer: str = "ratio",
) -> DataFrame:
    """Best score of every term at or above the threshold in every text.

    Only the terms themselves are compared, not their aliases.  ``ratio`` counts insertions and
    deletions, ``levenshtein`` is one minus the edit distance over the longer length.
    """
    if scorer not in SCORERS:
        raise ValueError(f"scorer is one of {SCORERS}")
    # Scores are rounded to whole percent, so pairs half a percent below still reach it.
    cutoff = threshold - 0.005 if scorer == "ratio" else threshold
    targets = _named(term_table(df, terms))
    different = targets.select(F.size(F.split("form", " ")).alias("words"), "form").distinct()
    forms = materialize(df.select(key, match_form(F.col(text)).alias("t")), "forms")
    vocabulary = distinct_phrases(forms, "t", PairGate(different, "form", cutoff)).distinct()
    sizes = F.length("phrase") + F.length("form")
    near = (
        candidates(vocabulary, different, cutoff)
        # Gives up beyond the limit, with -1.
        .withColumn("distance", F.call_function("levenshtein", F.col("phrase"), F.col("form"), allowed(sizes, cutoff)))
        .where("distance >= 0")
    )
    if scorer == "ratio":
        scored = near.withColumn("score", ratio("phrase", "form"))
    else:
        scored = near.withColumn("score", 1 - F.col("distance") / F.greatest(F.length("phrase"), F.length("form")))
    hits = materialize(
        scored.where(F.col("score") >= threshold).select("words", "phrase", "form", "score").join(targets, "form").drop("form"),
        "fuzzy-hits",
    )
    # Few phrases are hits, so the texts are searched again for these alone, instead of shuffling all.
    gate = PhraseGate(hits.select("phrase").distinct(), "phrase")
    return (
        phrases(forms, key, "t", gate.counts, gate)
        .join(hits, ["words", "phrase"])
        .groupBy(key, "dict", "keyword", "category", "subcategory", "weight")
        .agg(F.max("score").alias("score"))
    )


def add_fuzzy(matches: DataFrame, fuzzy: DataFrame, key: str) -> DataFrame:
    """Exact and alias matches, and fuzzy ones of the terms that have neither."""
    extra = fuzzy.select(
        key,
        "dict",
        "keyword",
        F.col("keyword").alias("matched_text"),
        "score",
        F.lit("fuzzy").alias("match_type"),
        "category",
        "weight",
        "subcategory",
    )
    fields = [c for c in extra.columns if c not in (key, "dict", "keyword")]
    rank = F.when(F.col("match_type") == "fuzzy", 1).otherwise(0)
    return (
        matches.select(*extra.columns)
        .unionByName(extra)
        .groupBy(key, "dict", "keyword")
        .agg(F.min_by(F.struct(*fields), F.struct(rank, "category")).alias("m"))
        .select(key, "dict", "keyword", "m.*")
    )

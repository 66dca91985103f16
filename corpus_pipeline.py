"""Five stages from raw documents to packed training sequences.

Every stage works on whole texts of all documents that its predecessor kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylake.llm import fuzzy_lines, language, ngram_join
from vacancylake.llm.decontamination import without_leaks
from vacancylake.llm.packing import pack
from vacancylake.llm.registry import tokenizer_file
from vacancylake.llm.tables import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language one can tell, with at least even odds; others go.

    The model is learned from the same rows as the query's, those that aren't held out.
    """
    model = language.train(language.learned_rows(docs))
    return language.in_languages(docs, model)


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line that repeats an earlier one taken out of its text."""
    kept = fuzzy_lines.deduplicate(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shared word five-grams connect."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    return pack(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_identified),
    ("line_dedup", lines_deduplicated),
    ("ngram_join", near_copies_removed),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Learned models, hashes and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's rows are written to the shared folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The numbered operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylake.llm import (
    block_names,
    fuzzy_lines,
    language_model,
    merkle,
    oracle,
    prefix_trie,
    quality,
    substrings,
    suffixes,
)
from vacancylake.llm.decontamination import leaks
from vacancylake.llm.language import identify
from vacancylake.llm.ngram_join import linked_documents
from vacancylake.llm.packing import pack
from vacancylake.llm.sharding import shard
from vacancylake.llm.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = dict(oracle.ORACLE)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_best_fit_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op2_balanced_shards(spark, sf_dir):
    return shard(read_table(spark, sf_dir, "documents"))


@query
def op10_language(spark, sf_dir):
    return identify(read_table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


@query
def op4_substring_dedup(spark, sf_dir):
    return substrings.deduplicate(read_table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark, sf_dir):
    return suffixes.deduplicate(read_table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark, sf_dir):
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op8_ngram_join(spark, sf_dir):
    return linked_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark, sf_dir):
    kept = fuzzy_lines.deduplicate(read_table(spark, sf_dir, "documents"), every=True)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


@query
def op3_lm_score(spark, sf_dir):
    return language_model.score(read_table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


@query
def op13_block_names(spark, sf_dir):
    return block_names.deduplicate(read_table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read_table(spark, sf_dir, "documents"))

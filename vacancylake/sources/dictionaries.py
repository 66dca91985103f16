"""Term dictionaries as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylake.schemas import TERM
from vacancylake.sources.vocabulary import DICTIONARIES, Term, flatten


def builtin_terms(spark: SparkSession, dictionaries: dict[str, dict] | None = None) -> DataFrame:
    """The built-in dictionaries, one row per surface form."""
    return spark.createDataFrame(flatten(dictionaries or DICTIONARIES), TERM)


#: Terms on one line of a written dictionary, about; a line is what one task reads at least.
TERMS_PER_LINE = 100


def read_dictionary(spark: SparkSession, path: str, name: str, *, lines: bool = False) -> DataFrame:
    """Terms of a JSON file ``{group: {term: {category, weight, aliases}}}``.

    With ``lines`` every line is such an object, with some terms of some group, and files are read
    in splits; a dictionary of any size is written that way.  Without, each file is one object.  A
    group that is itself a term, as in a flat file, becomes a term of group ``name``.
    """
    raw = spark.read.text(path, wholetext=not lines)
    groups = raw.select(
        F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "members")
    )
    flat = F.map_contains_key("members", "aliases") | F.map_contains_key("members", "weight")
    nested = groups.where(~flat).select(
        F.col("key").alias("category"), F.explode("members").alias("term", "body")
    )
    single = groups.where(flat).select(
        F.lit(name).alias("category"), F.col("key").alias("term"), F.to_json("members").alias("body")
    )
    return surface_forms(nested.unionByName(single), name)


def write_dictionary(entries: DataFrame, path: str) -> None:
    """``(category, term, body)`` rows, a term once in a category, as lines for ``read_dictionary``.

    A line holds terms of one category that share a hash, so neither a large category nor a large
    dictionary comes together anywhere.
    """
    dealt = F.pmod(F.xxhash64("category", "term"), F.lit(max(1, entries.count() // TERMS_PER_LINE)))
    body = F.from_json("body", "category string, weight double, aliases array<string>")
    grouped = entries.groupBy("category", dealt.alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("term", body))).alias("terms")
    )
    grouped.select(F.to_json(F.create_map("category", "terms")).alias("value")).write.text(path)


def surface_forms(entries: DataFrame, name: str) -> DataFrame:
    """``(category, term, body)`` rows to one row per term or alias; weight defaults to 1."""
    # Path by path, since a flat entry comes with its parts as text.
    weight = F.get_json_object("body", "$.weight").try_cast("double")
    aliases = F.from_json(F.get_json_object("body", "$.aliases"), "array<string>")
    aliases = F.coalesce(aliases, F.array())
    return entries.select(
        F.lit(name).alias("dict"),
        "category",
        F.coalesce(F.get_json_object("body", "$.category"), F.lit("")).alias("subcategory"),
        "term",
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
        F.posexplode(F.concat(F.array("term"), aliases)).alias("alias_pos", "alias"),
    ).select(*TERM.fieldNames())


def collect_terms(terms: DataFrame) -> Iterable[Term]:
    """Terms of a dictionary table known to be small, for a ``TermIndex``."""
    rows = terms.select(*TERM.fieldNames()).collect()
    return [Term(*row) for row in sorted(rows, key=lambda r: (r.dict, r.category, r.term, r.alias_pos))]

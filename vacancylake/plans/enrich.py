"""From postings to enriched postings.

Enrichment is one pass over the rows: cleaning, rules, spotting and matching are columns, so
nothing is shuffled however long the texts or skewed the sources are.  Only a dictionary too large
for a literal, and fuzzy matching, join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylake.functions import rules, spotting
from vacancylake.functions.arrays import empty_strings, size0, tagged
from vacancylake.functions.text import clean, computed_once, longer_than
from vacancylake.operators.fuzzy import add_fuzzy, fuzzy_matches
from vacancylake.operators.term_match import (
    SCORED,
    SENIORITY_DICT,
    TermIndex,
    by_dictionary,
    keyword_confidence,
    match_by_join,
    seniority,
)
from vacancylake.schemas import MATCH
from vacancylake.sources.dictionaries import builtin_terms, collect_terms

NLP_VERSION = "1.0"
MIN_DESCRIPTION = 50
MIN_BACKFILL_DESCRIPTION = 20
DONE = "vietnamese_analysis_completed"

RULE_FIELDS = list(rules.RULES)
SPOTTED_FIELDS = ["skills", "technologies", "roles", "responsibilities", "qualifications"]
MATCH_FIELDS = {
    "skills": "matched_skills",
    "technologies": "matched_technologies",
    "soft_skills": "matched_soft_skills",
    "industry_terms": "matched_industry_terms",
    "vietnamese_keywords": "vietnamese_keywords",
    "extended_technologies": "extended_technologies",
}


def _spotted(clean_text: Column, matched: Column, mode: str) -> dict[str, Column]:
    if mode == "substring":
        found = {k: spotting.substrings(clean_text, k) for k in spotting.SUBSTRINGS}
        return {f: found.get(f, empty_strings()) for f in SPOTTED_FIELDS}
    found = {f: matched[f"label_{f}"] for f in SPOTTED_FIELDS}
    found["skills"] = F.array_distinct(
        F.concat(found["skills"], spotting.contextual_skills(clean_text))
    )
    return found


def text_guards(max_length: int | None = None, text: str = "description") -> dict[str, Column]:
    """Why a text can't be processed: bytes that are no text, or more signs than one wants to run patterns on."""
    guards = {"invalid_utf8": ~F.is_valid_utf8(F.col(text))}
    return {**guards, "too_long": F.length(text) > max_length} if max_length else guards


def _no_matches() -> Column:
    return F.array().cast(T.ArrayType(MATCH))


def _with_joined(
    df: DataFrame, text: str, terms: DataFrame | None, fuzzy: bool, cleaning: dict
) -> tuple[DataFrame, list[str]]:
    """``df`` with the matches of a large dictionary and the fuzzy ones as maps, and its names.

    Matches are found once for each different text, which is told by its hash: ids may be missing or repeated.
    """
    key = "_text_hash"
    df = df.withColumn(key, F.unhex(F.md5(F.col(text).cast("binary"))))
    cleaned = df.where(F.col(key).isNotNull()).select(key, clean(F.col(text), **cleaning).alias("_c"))
    names: list[str] = []
    if terms is not None:
        names = sorted(r["dict"] for r in terms.select("dict").distinct().collect())
        rows = match_by_join(cleaned, key, "_c", terms, whole_phrases=True)
        # Hashed by their matches, so that the texts are not sorted.
        df = df.join(by_dictionary(rows, key).withColumnRenamed("matches", "_by_join").hint("shuffle_hash"), key, "left")
    if fuzzy:
        known = terms if terms is not None else builtin_terms(df.sparkSession)
        rows = fuzzy_matches(cleaned.dropDuplicates([key]), key, "_c", known)
        none = rows.sparkSession.createDataFrame([], LONG_MATCH.format(rows.schema[key].dataType.simpleString(), key=key))
        found = by_dictionary(add_fuzzy(none, rows, key), key)
        df = df.join(found.withColumnRenamed("matches", "_by_spelling").hint("shuffle_hash"), key, "left")
    return df.drop(key), names


LONG_MATCH = (
    "{key} {0}, dict string, keyword string, matched_text string, score double, match_type string, "
    "category string, weight double, subcategory string"
)


def _completed(found: Column, spelt: Column) -> Column:
    """Matches, and fuzzy ones of the terms that have none, best score first."""
    known = F.transform(found, lambda m: m["keyword"])
    new = F.filter(F.coalesce(spelt, _no_matches()), lambda m: ~F.array_contains(known, m["keyword"]))
    placed = F.transform(
        F.concat(found, new), lambda m, i: F.struct((-m["score"]).alias("s"), i.alias("i"), m.alias("m"))
    )
    return F.transform(F.array_sort(placed), lambda p: p["m"])


def extract(
    df: DataFrame,
    text: str = "description",
    *,
    index: TermIndex | None = None,
    terms: DataFrame | None = None,
    fuzzy: bool = False,
    mode: str = "patterns",
    cleaning: dict | None = None,
    only: Column | None = None,
    failed: Column | None = None,
) -> DataFrame:
    """Add ``description_cleaned``, ``extracted`` and ``confidence_scores`` to every row.

    The dictionary is the built-in one, an ``index``, or a table of ``terms`` of any size; a small
    table is matched inside the row, a large one by joins, with the same matches.  ``fuzzy`` adds
    terms that are nearly spelt like a phrase of the text, which joins on the text's hash.

    Where ``only`` is given and false, every field is NULL, or empty where ``failed`` holds.  The
    condition sits on the matches and the other fields, not on the structs, so that a reader of a
    few fields computes no others.
    """
    if mode not in spotting.SPOTTING_MODES:
        raise ValueError(f"mode is one of {spotting.SPOTTING_MODES}")
    large = terms is not None and not TermIndex.holds(terms)
    if large:
        index = TermIndex([])
    elif terms is not None:
        index = TermIndex(collect_terms(terms))
    index = index or TermIndex.builtin()
    names = list(index.names)
    if large or fuzzy:
        df, joined = _with_joined(df, text, terms, fuzzy, cleaning or {})
        names += [n for n in joined if n not in names] if large else []
    df = df.withColumn("_only", F.lit(True) if only is None else only)
    if failed is not None:
        df = df.withColumn("_failed", failed)

    def gated(value: Column) -> Column:
        return value if only is None else F.when(F.col("_only"), value)

    def or_empty(value: Column, empty: Column) -> Column:
        return value if failed is None else F.when(F.col("_failed"), empty).otherwise(value)

    whole = computed_once(clean(F.col(text), **(cleaning or {})))
    df = df.withColumn("description_cleaned", or_empty(gated(whole), F.lit("")))
    cleaned, matched = F.col("description_cleaned"), F.col("_matched")
    df = df.withColumn("_matched", gated(index.match(cleaned)))

    def matches(name: str) -> Column:
        if large:
            found = F.coalesce(F.try_element_at("_by_join", F.lit(name)), _no_matches())
        else:
            found = matched[name]
        return gated(_completed(found, F.try_element_at("_by_spelling", F.lit(name)))) if fuzzy else gated(found)

    fields = {
        **{k: gated(c) for k, c in rules.extract_all(cleaned).items()},
        **{k: gated(c) if mode == "substring" else c for k, c in _spotted(cleaned, matched, mode).items()},
        "benefits": gated(empty_strings()),
        **{field: matches(name) if name in names else gated(_no_matches()) for name, field in MATCH_FIELDS.items()},
        **{f"matched_{name}": matches(name) for name in names if name not in MATCH_FIELDS},
    }
    if SENIORITY_DICT not in names:
        fields["seniority_levels"] = gated(_no_matches())
    elif large or fuzzy:
        fields["seniority_levels"] = gated(seniority(matches(SENIORITY_DICT)))
    else:
        fields["seniority_levels"] = matched["seniority_levels"]
    texts = {*RULE_FIELDS, *SPOTTED_FIELDS, "benefits"}
    fields = {n: or_empty(c, empty_strings() if n in texts else _no_matches()) for n, c in fields.items()}
    # Every field is a column of its own before it goes into the struct, so that the counters
    # computed from it do not compute it again.  The number of the partition keeps the planner from
    # putting the fields into the struct, where two that are read would have all of them computed.
    df = df.withColumns({**{f"_{n}": c for n, c in fields.items()}, "_part": F.spark_partition_id()})
    kept = {n: F.col(f"_{n}") for n in fields}
    kept["benefits"] = F.when(F.col("_part") >= 0, kept["benefits"])
    extracted = F.struct(*[c.alias(n) for n, c in kept.items()])
    every = {n: F.col(f"_{MATCH_FIELDS.get(n, f'matched_{n}')}") for n in names}
    total = reduce(Column.__add__, [size0(c) for c in every.values()], F.lit(0))
    spotted = [F.col(f"_{f}") for f in [*SPOTTED_FIELDS, "benefits"]]
    scored = [F.col(f"_{MATCH_FIELDS[n]}") for n in SCORED]
    confidence = F.struct(
        gated(
            F.lit(spotting.SUBSTRING_CONFIDENCE)
            if mode == "substring"
            else spotting.pattern_confidence(spotted)
        ).alias("ner_confidence"),
        gated(keyword_confidence(scored, total)).alias("keyword_confidence"),
        gated(total).alias("total_matches"),
    )
    return df.withColumns({"extracted": extracted, "confidence_scores": confidence}).drop(
        "_only", "_failed", "_matched", "_by_join", "_by_spelling", "_part", *[f"_{n}" for n in fields]
    )


def extraction_stats(text: str = "description", only: Column | None = None) -> dict[str, Column]:
    """Ten counters describing what a posting yielded, NULL where ``only`` is false."""
    e = F.col("extracted")
    counters = [
        size0(e["skills"]),
        size0(e["technologies"]),
        size0(e["responsibilities"]),
        size0(e["qualifications"]),
        size0(e["matched_skills"]) + size0(e["matched_technologies"]),
        F.length(text),
        F.length("description_cleaned"),
        size0(e["vietnamese_keywords"]),
        size0(e["seniority_levels"]),
        size0(e["extended_technologies"]),
    ]
    return {n: c if only is None else F.when(only, c) for n, c in zip(STATS, counters)}


STATS = [
    "total_skills", "total_technologies", "total_responsibilities", "total_qualifications",
    "total_matches", "text_length_original", "text_length_cleaned",
    "vietnamese_keywords_count", "seniority_levels_count", "extended_technologies_count",
]
ENRICHED = ["extracted", "processing", "extraction_stats", DONE, "description_cleaned"]


def enrich(
    postings: DataFrame,
    *,
    min_length: int = MIN_DESCRIPTION,
    keep_short: bool = False,
    index: TermIndex | None = None,
    terms: DataFrame | None = None,
    fuzzy: bool = False,
    mode: str = "patterns",
    guards: dict[str, Column] | None = None,
) -> DataFrame:
    """Enriched postings; ``index``, ``terms`` and ``fuzzy`` as in ``extract``.

    Rows whose description is too short are left out, or with ``keep_short`` kept with NULL in
    the added columns.  ``guards`` (reason: condition, as ``text_guards``) name rows that can't be
    processed: nothing is computed for them, they keep an empty result with the first reason in
    ``processing.error``, and aren't done, so that a later run meets them again.
    """
    enough = longer_than(F.col("description"), min_length)
    only = failed = None
    if keep_short:
        postings = postings.withColumn("_enough", enough)
        only = F.col("_enough")
    else:
        postings = postings.where(enough)
    error = F.lit(None).cast("string")
    if guards:
        reason = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in guards.items()])
        postings = postings.withColumn("_error", reason if only is None else F.when(only, reason))
        error = F.col("_error")
        failed = error.isNotNull()
        only = ~failed if only is None else only & ~failed
    df = extract(postings, index=index, terms=terms, fuzzy=fuzzy, mode=mode, only=only, failed=failed)
    done = F.lit(True)
    processing = F.struct(
        F.when(done if only is None else only, F.current_timestamp()).alias("processed_at"),
        F.lit(NLP_VERSION).alias("nlp_version"),
        F.col("confidence_scores"),
        error.alias("error"),
    )
    # The counters are columns of their own before they go into the struct, as the fields in ``extract``.
    stats = extraction_stats(only=only if failed is None else only | failed)
    df = df.withColumns({**{f"_{n}": c for n, c in stats.items()}, "_part": F.spark_partition_id()})
    counted = {n: F.when(F.col("_part") >= 0, F.col(f"_{n}")) if n == STATS[-1] else F.col(f"_{n}") for n in stats}
    return df.withColumns(
        {
            "processing": processing,
            "extraction_stats": F.struct(*[c.alias(n) for n, c in counted.items()]),
            DONE: done if only is None else F.when(only, done),
        }
    ).drop("confidence_scores", "_enough", "_error", "_part", *[f"_{n}" for n in stats])


RECORD_LISTS = [
    "dates", "durations", "emails", "urls", "phone_numbers",
    "skills", "roles", "technologies", "responsibilities", "qualifications", "benefits",
    "matched_skills", "matched_technologies", "matched_soft_skills", "matched_industry_terms",
    "vietnamese_keywords", "seniority_levels", "extended_technologies",
]


def full_record(enriched: DataFrame, key: str = "job_id") -> DataFrame:
    """The extraction result as one flat record per posting."""
    return enriched.select(
        key,
        F.col("description").alias("original_description"),
        F.col("description_cleaned").alias("cleaned_text"),
        *[F.col(f"extracted.{f}").alias(f) for f in RECORD_LISTS],
        F.col("processing.confidence_scores").alias("confidence_scores"),
        F.col("processing.processed_at").alias("timestamp"),
    )


def long_form(enriched: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """``(key, kind, value)`` rows of the given string-list fields."""
    values = F.flatten(
        F.array(*[tagged(F.coalesce(F.col(f"extracted.{f}"), empty_strings()), f) for f in fields])
    )
    return enriched.select(key, F.explode(values).alias("e")).select(key, "e.kind", "e.value")

"""Every operator as a query over the test tables.

Each takes ``(spark, sf_dir)`` and returns scalars in long form, so that another SQL engine can
be asked the same question (``checks.oracle``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylake.functions import cards, rules, spotting, text
from vacancylake.functions.arrays import size0, tagged
from vacancylake.functions.entities import unescape
from vacancylake.operators import html_cards
from vacancylake.operators.fuzzy import add_fuzzy, fuzzy_matches
from vacancylake.operators.html_cards import parse_cards, parse_descriptions
from vacancylake.operators.joins import filter_members, lookup, update_by_key
from vacancylake.operators.term_match import (
    SCORED,
    TermIndex,
    long_matches,
    label_places,
    match_by_join,
    top_matches,
)
from vacancylake.plans import process, reports
from vacancylake.plans.enrich import DONE, MATCH_FIELDS, enrich, extract, full_record, long_form, text_guards
from vacancylake.plans.process import (
    backfill,
    process_all,
    process_urls,
    run,
    select_pending,
    status,
)
from vacancylake.schemas import MATCH
from vacancylake.session import COMPRESSION, shared_dir
from vacancylake.sources import postings as source
from vacancylake.sources.dictionaries import builtin_terms, read_dictionary, surface_forms, write_dictionary
from vacancylake.sources.store import read_current
from vacancylake.sources.vocabulary import DICTIONARIES, flatten
from vacancylake.streaming.incremental import enrich_stream, read_arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


jobs = source.derived_postings


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job_id", text.clean(F.col("description")).alias("c"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(jobs(spark, sf_dir), keep_short=True)


def processed_before(postings: DataFrame) -> DataFrame:
    """Stands for the rows an earlier run finished: those of one site."""
    return postings.where(F.col("source") == "topcv").select("url")


# --- reading, selecting, updating


@query
def scan_by_source(spark, sf_dir):
    return source.get_postings(jobs(spark, sf_dir), "linkedin").select("job_id", "title", "url")


@query
def scan_limit(spark, sf_dir):
    return source.get_postings(jobs(spark, sf_dir), "itviec", limit=25).select("job_id", "title")


@query
def count_by_source(spark, sf_dir):
    return source.count_postings(jobs(spark, sf_dir), "linkedin")


@query
def count_per_source(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query
def known_urls(spark, sf_dir):
    return source.known_urls(jobs(spark, sf_dir))


@query
def with_description(spark, sf_dir):
    return jobs(spark, sf_dir).where(text.has_text(F.col("description"))).select("job_id")


@query
def minimum_length(spark, sf_dir):
    """Which of the three length limits every posting passes."""
    return jobs(spark, sf_dir).select(
        "job_id", *[text.longer_than(F.col("description"), n).alias(f"at_least_{n}") for n in (10, 20, 50)]
    )


@query
def previews(spark, sf_dir):
    return jobs(spark, sf_dir).select(
        "job_id",
        *[text.preview(F.col("description"), n).alias(f"p{n}") for n in (100, 150, 200)],
        text.preview(F.col("title"), 40).alias("t40"),
        reports.or_unknown("company").alias("company"),
    )


@query
def missing_field(spark, sf_dir):
    return jobs(spark, sf_dir).where(F.col("salary").isNull()).select("job_id")


@query
def not_yet_processed(spark, sf_dir):
    postings = jobs(spark, sf_dir)
    return select_pending(postings, processed_before(postings)).select("job_id", "url")


@query
def not_yet_processed_by_shuffle(spark, sf_dir):
    """The same through the shuffle that large key sets take."""
    postings = jobs(spark, sf_dir).where(text.has_text(F.col("description"))).select("job_id", "url")
    done = source.known_urls(processed_before(jobs(spark, sf_dir)))
    return filter_members(postings, done, "url", keep=False, hint="merge")


def _wanted(spark, sf_dir):
    """Urls asked for: one per customer, some of which no posting has."""
    url = F.concat(F.lit("https://jobs.example.org/view/"), (F.col("c_custkey") * 17).cast("string"))
    return table(spark, sf_dir, "customer").select(url.alias("url"))


@query
def wanted_urls_found(spark, sf_dir):
    found, _ = lookup(jobs(spark, sf_dir), _wanted(spark, sf_dir), "url")
    return found.select("job_id", "url")


@query
def wanted_urls_missing(spark, sf_dir):
    _, missing = lookup(jobs(spark, sf_dir), _wanted(spark, sf_dir), "url")
    return missing


@query
def wanted_urls_processed(spark, sf_dir):
    done, _ = process_urls(jobs(spark, sf_dir), _wanted(spark, sf_dir))
    return done.select("job_id", F.col(DONE).alias("done"), size0(F.col("extracted.skills")).alias("skills"))


@query
def keyed_update(spark, sf_dir):
    """Sets company and adds a flag on the postings of finished orders."""
    base = jobs(spark, sf_dir).select("job_id", "title", "company")
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    new = finished.select(
        F.col("o_orderkey").alias("job_id"), F.lit("Filled").alias("company"), F.lit(True).alias("closed")
    )
    return update_by_key(base, new, "job_id")


@query
def repeated_updates(spark, sf_dir):
    """Several updates of one posting, one per line of its order: the last line counts."""
    base = jobs(spark, sf_dir).select("job_id", "title", "company")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("company"),
        "l_linenumber",
    )
    return update_by_key(base, lines, "job_id", ["company"], latest="l_linenumber")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def appended_twice(spark, sf_dir):
    """Postings appended in two parts and read back."""
    postings, path = jobs(spark, sf_dir), _scratch(spark, "postings")
    columns = ["job_id", "title", "company", "location", "url", "source", "salary", "posted_at", "description"]
    for part in (F.col("source") == "topcv", F.col("source") != "topcv"):
        source.append_postings(postings.where(part).select(*columns), path)
    return source.read_postings(spark, path).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.length("description")).alias("chars")
    )


@query
def json_written(spark, sf_dir):
    path = _scratch(spark, "json")
    source.write_json(jobs(spark, sf_dir).select("job_id", "title", "company", "url"), path)
    return spark.read.schema("job_id long, title string, company string, url string").json(path)


@query
def dictionary_from_table(spark, sf_dir):
    """Parts as a user dictionary: types are groups, names terms, brand and maker aliases."""
    parts = table(spark, sf_dir, "part")
    body = F.to_json(F.struct(F.col("p_brand").alias("category"), F.array("p_brand", "p_type").alias("aliases")))
    entries = parts.select(F.col("p_type").alias("category"), F.col("p_name").alias("term"), body.alias("body"))
    return surface_forms(entries, "parts")


@query
def records_as_postings(spark, sf_dir):
    """Customers as records with some fields of a posting and others it lacks."""
    records = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("company"),
        F.array("c_mktsegment").alias("tags"), F.col("c_acctbal").alias("balance"),
    )
    got = source.as_postings(records)
    return got.select("job_id", "title", "company", "location", "applicants", F.array_join("tags", "|").alias("tags"))


# --- cleaning


@query
def clean_descriptions(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean(F.col("html")).alias("c"))


@query
def clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("c"))


@query
def decode_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", unescape(F.col("html")).alias("t"))


@query
def tags_to_layout(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.tags_to_layout(F.col("html")).alias("t"))


@query
def bullets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        text.symbol_bullets(F.col("text")).alias("symbols"),
        text.numbered_bullets(F.col("text")).alias("numbers"),
    )


@query
def special_characters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.remove_special(F.col("text")).alias("t"))


@query
def whitespace_and_punctuation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        text.collapse_whitespace(F.col("text")).alias("one_line"),
        text.tidy_punctuation(text.tidy_lines(F.col("text"))).alias("tidy"),
    )


@query
def normalized_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        text.normalize(F.col("text")).alias("normalized"),
        text.match_form(F.col("text")).alias("match_form"),
    )


@query
def cleaning_stats(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("job_id", "description", text.clean(F.col("description")).alias("c"))
    known = rows.where(F.col("description").isNotNull())
    return known.select("job_id", text.cleaning_stats(F.col("description"), F.col("c")).alias("s")).select("job_id", "s.*")


def _sectioned(spark, sf_dir):
    """Documents laid out under the headings of a posting, line breaks kept."""
    d = table(spark, sf_dir, "documents")
    layout = F.concat(
        F.lit("Overview:\n"), F.col("lang"), F.lit(" posting\nRequirements:\n• 3+ years of experience, MBA\n"),
        F.replace("text", F.lit(":"), F.lit(" ")), F.lit("\nBenefits:\nremote work, "), F.col("source"),
        F.lit("\nContact: none\n"),
    )
    return d.select("doc_id", layout.alias("t"))


@query
def sections(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("doc_id", text.sections(F.col("t")).alias("s")).select(
        "doc_id", "s.requirements", "s.responsibilities", "s.benefits", "s.about", "s.description"
    )


@query
def requirements_section(spark, sf_dir):
    r = _sectioned(spark, sf_dir).select("doc_id", rules.requirements(F.col("t")).alias("r"))
    return r.select(
        "doc_id",
        "r.raw_requirements",
        *[F.size(f"r.{k}").alias(k) for k in ("durations", "education_levels", "work_arrangements")],
    )


# --- rules and spotting


def _long(df: DataFrame, values: Column, key: str = "job_id") -> DataFrame:
    return df.select(key, F.explode(values).alias("value"))


def _rule_query(kind: str) -> None:
    def run_rule(spark, sf_dir):
        return _long(cleaned(spark, sf_dir), rules.extract(F.col("c"), kind))

    QUERIES[f"rule_{kind}"] = run_rule


for _kind in rules.RULES:
    _rule_query(_kind)


@query
def rules_on_documents(spark, sf_dir):
    """Every kind on the raw documents."""
    d = table(spark, sf_dir, "documents")
    found = rules.extract_all(F.col("text"))
    pairs = F.flatten(F.array(*[tagged(v, k) for k, v in found.items()]))
    return d.select("doc_id", F.explode(pairs).alias("e")).select("doc_id", "e.kind", "e.value")


@query
def contact_info(spark, sf_dir):
    r = cleaned(spark, sf_dir).select("job_id", rules.contact_info(F.col("c")).alias("i"))
    return r.select(
        "job_id",
        *[F.array_join(F.array_sort(f"i.{k}"), "|").alias(k) for k in ("emails", "phone_numbers", "urls")],
    )


@query
def extraction_summary(spark, sf_dir):
    e = extract(jobs(spark, sf_dir))
    fields = ["dates", "durations", "emails", "urls", "phone_numbers", "salaries",
              "work_arrangements", "education_levels"]
    return e.select(
        "job_id", reports.extraction_summary(F.col("extracted"), fields).alias("s")
    ).select("job_id", "s.*")


index = TermIndex.builtin


@query
def token_patterns(spark, sf_dir):
    """Phrases per label."""
    m = cleaned(spark, sf_dir).select("job_id", index().match(F.col("c")).alias("m"))
    pairs = F.concat(*[tagged(F.col(f"m.label_{x}"), x, "label") for x in spotting.LABELS])
    return m.select("job_id", F.explode(pairs).alias("e")).select("job_id", "e.label", "e.value")


@query
def label_positions(spark, sf_dir):
    """Phrases per label with every place they stand at."""
    return label_places(cleaned(spark, sf_dir), "job_id", "c")


@query
def contextual_skills(spark, sf_dir):
    """On descriptions that end in a sentence listing skills."""
    extra = F.concat(F.col("description"), F.lit(" Experience with Spark, Kafka; Hive and Oozie, Flink. Skilled in "),
                     F.lower("title"), F.lit(", of and go! Knowledge of "), F.lower("location"), F.lit(".\n"))
    rows = jobs(spark, sf_dir).select("job_id", text.clean(extra).alias("c"))
    return _long(rows, F.array_distinct(spotting.contextual_skills(F.col("c"))))


@query
def substring_keywords(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    pairs = F.concat(*[tagged(spotting.substrings(F.col("c"), k), k) for k in spotting.SUBSTRINGS])
    return c.select("job_id", F.explode(pairs).alias("e")).select("job_id", "e.kind", "e.value")


@query
def substring_mode(spark, sf_dir):
    e = extract(jobs(spark, sf_dir), mode="substring")
    return e.select(
        "job_id",
        size0(F.col("extracted.skills")).alias("skills"),
        size0(F.col("extracted.responsibilities")).alias("responsibilities"),
        F.col("confidence_scores.ner_confidence").alias("ner_confidence"),
    )


# --- dictionary matching


@query
def dictionary_matches(spark, sf_dir):
    return long_matches(cleaned(spark, sf_dir), "job_id", "c", index())


@query
def dictionary_matches_by_join(spark, sf_dir):
    return match_by_join(cleaned(spark, sf_dir), "job_id", "c", builtin_terms(spark))


@query
def dictionary_matches_by_shuffle(spark, sf_dir):
    """On whole phrases, as a dictionary too large to broadcast is matched."""
    return match_by_join(cleaned(spark, sf_dir), "job_id", "c", builtin_terms(spark), whole_phrases=True)


@query
def dictionary_matches_in_documents(spark, sf_dir):
    return long_matches(table(spark, sf_dir, "documents"), "doc_id", "text", index())


@query
def seniority_matches(spark, sf_dir):
    e = extract(jobs(spark, sf_dir))
    m = e.select("job_id", F.explode(F.coalesce(F.col("extracted.seniority_levels"), F.array())).alias("m"))
    return m.select("job_id", "m.keyword", "m.matched_text", "m.subcategory")


@query
def confidence_scores(spark, sf_dir):
    e = extract(jobs(spark, sf_dir))
    return e.select(
        "job_id",
        F.round("confidence_scores.keyword_confidence", 9).alias("keyword_confidence"),
        F.round("confidence_scores.ner_confidence", 9).alias("ner_confidence"),
        F.col("confidence_scores.total_matches").alias("total_matches"),
    )


@query
def top_matches_per_job(spark, sf_dir):
    m = cleaned(spark, sf_dir).select("job_id", index().match(F.col("c")).alias("m"))
    best = top_matches({n: F.col(f"m.{n}") for n in SCORED}, 10)
    r = m.select("job_id", F.posexplode(F.concat(best)).alias("rank", "x"))
    return r.select("job_id", "rank", "x.score", "x.keyword", "x.match_type", "x.match_category")


@query
def matches_by_score(spark, sf_dir):
    """The matches of one dictionary in the order they are listed."""
    m = cleaned(spark, sf_dir).select("job_id", index().match(F.col("c")).alias("m"))
    r = m.select("job_id", F.posexplode(F.concat(F.col("m.vietnamese_keywords"))).alias("at", "x"))
    return r.select("job_id", "at", "x.score", "x.keyword", "x.matched_text")


@query
def fuzzy_by_levenshtein(spark, sf_dir):
    f = fuzzy_matches(cleaned(spark, sf_dir), "job_id", "c", flatten(DICTIONARIES), scorer="levenshtein")
    return f.select("job_id", "dict", "keyword", F.round("score", 9).alias("score"))


@query
def fuzzy_by_ratio(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    fuzzy = fuzzy_matches(c, "job_id", "c", flatten(DICTIONARIES))
    return add_fuzzy(long_matches(c, "job_id", "c", index()), fuzzy, "job_id")


@query
def enriched_with_fuzzy(spark, sf_dir):
    """Matches of every kind that enrichment finds when spelling may differ."""
    e = enrich(jobs(spark, sf_dir), fuzzy=True)
    lists = {d: F.col(f"extracted.{MATCH_FIELDS[d]}") for d in DICTIONARIES}

    def named(dictionary: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.concat_ws(":", F.lit(dictionary), m["keyword"], m["score"].cast("string")))

    return e.select(
        "job_id",
        *[F.size(c).alias(d) for d, c in lists.items()],
        F.array_join(F.array_sort(F.concat(*[named(d, c) for d, c in lists.items()])), "|").alias("found"),
    )


def _part_entries(spark, sf_dir):
    """Parts as a dictionary: names are terms, brand and type or brand and size aliases."""
    parts = table(spark, sf_dir, "part")
    aliases = F.array(F.concat_ws(" ", "p_brand", "p_type"), F.concat_ws(" ", "p_brand", F.lit("size"), F.col("p_size").cast("string")))
    body = F.to_json(F.struct(F.col("p_brand").alias("category"), aliases.alias("aliases")))
    return parts.select(F.col("p_type").alias("category"), F.col("p_name").alias("term"), body.alias("body"))


def _with_parts(spark, sf_dir):
    """Postings that name a part, and others by its brand and type."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    # Joined to the narrow orders, so that the texts aren't shuffled; it comes along with the date.
    orders = table(spark, sf_dir, "orders").join(F.broadcast(n), F.lit(True))
    named = orders.join(parts, F.col("o_orderkey") % F.col("n") + 1 == F.col("p_partkey"))
    part = F.concat(F.lit(" Handles "), "p_name", F.lit(", "), "p_brand", F.lit(" "), "p_type", F.lit("."))
    dated = F.struct(F.col("o_orderdate").alias("date"), part.alias("part"))
    rows = source.derived_postings(spark, sf_dir, named.select(*[c for c in orders.columns if c not in ("n", "o_orderdate")], dated.alias("o_orderdate")))
    changed = {"seen_at": F.col("seen_at.date"), "description": F.concat("description", F.col("seen_at.part"))}
    order = [*[c for c in rows.columns if c != "description"], "description"]
    return rows.select(*[changed[c].alias(c) if c in changed else c for c in order])


@query
def enriched_with_user_dictionary(spark, sf_dir):
    """Enrichment with a dictionary of parts: beyond scale 0.01 over 5,000 surface forms."""
    e = enrich(_with_parts(spark, sf_dir), terms=surface_forms(_part_entries(spark, sf_dir), "parts"))
    return _long(e, F.transform("extracted.matched_parts", lambda m: F.concat_ws("|", m["keyword"], m["match_type"], m["matched_text"])))


QUOTED_WORDS = 120


@query
def quoted_documents(spark, sf_dir):
    """Postings that quote the first 120 words of a document: a dictionary with an alias for each."""
    words = F.split(text.match_form(F.col("text")), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= QUOTED_WORDS)
    name = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    alias = F.array_join(F.slice("w", 1, QUOTED_WORDS), " ")
    entries = docs.select(F.lit("quotes").alias("category"), name.alias("term"), F.to_json(F.struct(F.array(alias).alias("aliases"))).alias("body"))
    found = match_by_join(cleaned(spark, sf_dir), "job_id", "c", surface_forms(entries, "quotes"), whole_phrases=True)
    return found.select("job_id", "keyword", "match_type")


@query
def dictionary_from_json(spark, sf_dir):
    """The dictionary of parts, groups by type, written as lines of JSON in many files and read back."""
    entries = _part_entries(spark, sf_dir).groupBy("category", "term").agg(F.max("body").alias("body"))
    path = _scratch(spark, "dictionary")
    write_dictionary(entries, path)
    return read_dictionary(spark, path, "parts", lines=True)


# --- cards


CARD_HTML = {
    "linkedin": (
        '<ul class="jobs-search__results-list"><li><a class="job-card-list__title" href="{url}">{title}</a>'
        '<span class="job-card-container__company-name">{company}</span>'
        '<div class="job-card-container__metadata-item">{location}</div><div>{posted}</div>'
        "<div>{applicants}</div></li></ul>"
    ),
    "itviec": (
        '<div class="job"><h3><a href="{url}">{title}</a></h3><div class="employer"><b>{company}</b></div>'
        '<ul><li class="city">{location}</li></ul><p>{posted}</p><p>{applicants}</p></div>'
    ),
    "topcv": (
        '<div class="job-item-default"><h3><a href="{url}">{title}</a></h3><a class="company">{company}</a>'
        '<label class="address"> {location} </label><label class="salary">{salary}</label>'
        "<p>{posted}</p><p>{applicants}</p></div>"
    ),
    "vietnamworks": (
        '<div class="job-card"><div class="job-title"><a href="{url}">{title}</a></div>'
        '<div class="company"><a>{company}</a></div><span class="job-location">{location}</span>'
        '<time datetime="{posted}">soon</time><p>{applicants}</p></div>'
    ),
}


def _filled(template: str) -> Column:
    names = {"applicants": "applicants_text", "posted": "posted_at"}
    pieces = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        value = F.coalesce(F.col(names.get(piece, piece)), F.lit("")) if i % 2 else F.lit(piece)
        pieces.append(value)
    return F.concat(*pieces)


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting as the page its site would show it on, after a card without title."""
    html = F.lit(None).cast("string")
    for site, template in CARD_HTML.items():
        html = F.when(F.col("source") == site, _filled(template)).otherwise(html)
    page = F.concat(F.lit('<html><body><div class="job job-card job-item-default"><p>ad</p></div>'), html,
                    F.lit("</body></html>"))
    return jobs(spark, sf_dir).select("job_id", "source", page.alias("html"))


def _card_query(site: str) -> None:
    def run_cards(spark, sf_dir):
        pages = card_pages(spark, sf_dir).where(F.col("source") == site)
        parsed = parse_cards(pages, "job_id", "source", "html")
        return parsed.select("job_id", "title", "company", "location", "url", "salary", "posted_at")

    QUERIES[f"cards_{site}"] = run_cards


for _site in CARD_HTML:
    _card_query(_site)


@query
def card_applicants(spark, sf_dir):
    parsed = parse_cards(card_pages(spark, sf_dir), "job_id", "source", "html")
    return parsed.select("job_id", cards.applicants(F.col("card_text")).alias("applicants"))


@query
def card_posted_at(spark, sf_dir):
    t = F.concat(F.col("title"), F.lit("\n"), F.coalesce("posted_at", F.lit("")), F.lit("\n"), F.col("location"))
    return jobs(spark, sf_dir).select("job_id", cards.posted_at(t).alias("posted_at"))


@query
def page_descriptions(spark, sf_dir):
    """Descriptions of pages whose text sits in two description blocks, one of them twice."""
    block = F.concat(F.lit('<div class="jobs-description__content"><p>'), F.col("title"),
                     F.lit('</p></div><div class="description__text">'), F.col("location"), F.lit("</div>"))
    pages = jobs(spark, sf_dir).select("job_id", F.concat(block, block).alias("html"))
    parts = parse_descriptions(pages, "job_id", "html")
    return parts.select("job_id", cards.join_fragments(F.col("parts")).alias("description"))


@query
def postings_from_pages(spark, sf_dir):
    """Postings built from the cards of pages, described by a page of their own or its panel."""
    own = F.concat(F.lit('<div class="description__text"><p>'), F.col("title"), F.lit("</p></div>"))
    panel = F.concat(
        F.lit('<div class="scaffold-layout__detail"><h1 class="job-title">'), F.col("title"),
        F.lit(" in a heading of some length</h1><p>About the work in "), F.col("location"), F.lit("</p><p>short</p></div>"),
    )
    details = jobs(spark, sf_dir).select(
        F.col("job_id").alias("id"), F.when(F.col("job_id") % 2 == 0, own).otherwise(panel).alias("details")
    )
    pages = card_pages(spark, sf_dir).join(details, F.col("job_id") == F.col("id")).withColumnRenamed("job_id", "page_id")
    found = html_cards.postings_from_pages(pages, "page_id", "source", "html", "details")
    return found.select(
        F.col("page_id").alias("page_id"), "title", "company", "location", "url", "source", "salary", "applicants",
        "posted_at", "description",
    )


@query
def search_urls(spark, sf_dir):
    """Search pages for every segment and nation, on every site."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    asked = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lower("c_mktsegment").alias("keyword"), F.lower("n_name").alias("location")
    ).distinct()
    sites = F.explode(F.array(*[F.lit(s) for s in cards.SEARCH_PAGES]))
    return asked.withColumn("site", sites).select(
        "site", "keyword", "location",
        cards.search_url(F.col("site"), F.col("keyword"), F.col("location")).alias("url"),
    )


@query
def element_text(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", text.text_or_null(F.col("text")).alias("t"))


# --- enrichment


@query
def enriched_long_form(spark, sf_dir):
    fields = ["dates", "durations", "emails", "urls", "phone_numbers", "salaries",
              "roles", "technologies", "responsibilities", "qualifications"]
    return long_form(enrich(jobs(spark, sf_dir)), fields)


@query
def full_records(spark, sf_dir):
    """The flat record, the values of its lists in alphabetical order."""
    r = full_record(enrich(jobs(spark, sf_dir)))
    return r.select(
        "job_id", "cleaned_text", *[_joined(F.col(f.name), f.dataType).alias(f.name) for f in r.schema if isinstance(f.dataType, T.ArrayType)]
    )


def _joined(values: Column, kind: T.ArrayType) -> Column:
    """The texts of a list, or the keywords of a list of matches, as one text."""
    names = values if isinstance(kind.elementType, T.StringType) else values["keyword"]
    return F.array_join(F.array_sort(names), "|")


ERROR_LENGTH = 2_000


@query
def enriched_with_errors(spark, sf_dir):
    """What became of every posting when descriptions beyond a length can't be processed."""
    e = enrich(jobs(spark, sf_dir), keep_short=True, guards=text_guards(ERROR_LENGTH))
    return e.select(
        "job_id",
        F.col("processing.error").alias("error"),
        F.coalesce(F.col(DONE), F.lit(False)).alias("done"),
        F.length("description_cleaned").alias("cleaned"),
        F.size("extracted.matched_skills").alias("skills"),
        F.size("extracted.emails").alias("emails"),
        F.col("extraction_stats.total_matches").alias("total_matches"),
    )


@query
def run_summary_with_errors(spark, sf_dir):
    selected = enrich(select_pending(jobs(spark, sf_dir)), keep_short=True, guards=text_guards(ERROR_LENGTH))
    return reports.run_summary(selected)


@query
def extraction_counters(spark, sf_dir):
    return enrich(jobs(spark, sf_dir)).select("job_id", "extraction_stats.*")


@query
def total_extractions(spark, sf_dir):
    return enrich(jobs(spark, sf_dir)).select("job_id", reports.total_extractions().alias("n"))


@query
def run_status(spark, sf_dir):
    selected = select_pending(jobs(spark, sf_dir))
    return selected.groupBy(status().alias("status")).agg(F.count("*").alias("n"))


@query
def run_summary(spark, sf_dir):
    postings = jobs(spark, sf_dir)
    return run(postings, processed_before(postings))[1]


@query
def run_enriched(spark, sf_dir):
    postings = jobs(spark, sf_dir)
    done, _ = run(postings, processed_before(postings))
    return done.select("job_id", F.col("extraction_stats.vietnamese_keywords_count").alias("n"))


@query
def backfilled(spark, sf_dir):
    done = backfill(jobs(spark, sf_dir))
    fields = {"soft": "matched_soft_skills", "industry": "matched_industry_terms", "vn": "vietnamese_keywords"}
    lists = {n: F.col(f"extracted.{f}") for n, f in fields.items()}
    return done.select(
        "job_id", *[F.size(c).alias(n) for n, c in lists.items()],
        *[_joined(c, T.ArrayType(MATCH)).alias(f"{n}_found") for n, c in lists.items()],
    )


@query
def stored_after_two_runs(spark, sf_dir):
    """The store after a run over one site and another over all."""
    postings, root = jobs(spark, sf_dir), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    process_all(spark, postings.where(F.col("source") == "topcv"), root)
    process_all(spark, postings, root)
    return read_current(spark, root).select(
        "job_id", F.col("extraction_stats.vietnamese_keywords_count").alias("n")
    )


@query
def reprocessed(spark, sf_dir):
    """The store after the postings of one site were changed and enriched again."""
    postings, root = jobs(spark, sf_dir), _scratch(spark, "store")
    process_all(spark, postings, root)
    new = F.lit("Senior Kotlin engineer with a text that is long enough, tiếng anh")
    changed = postings.where(F.col("source") == "topcv").withColumn("description", new)
    process.reprocess(spark, changed.unionByName(changed.where("job_id % 2 = 0")), root)
    return read_current(spark, root).select(
        "job_id", F.length("description").alias("chars"), F.length("description_cleaned").alias("cleaned")
    )


@query
def limited_run(spark, sf_dir):
    """What a run over the first postings left in the store."""
    root = _scratch(spark, "store")
    process_all(spark, jobs(spark, sf_dir), root, limit=40)
    return read_current(spark, root).select("job_id", F.col("processing.nlp_version").alias("version"))


@query
def streamed_repeats(spark, sf_dir):
    """The stream's output when every posting arrives twice in one batch."""
    root = _scratch(spark, "stream")
    arriving = jobs(spark, sf_dir)
    arriving.unionByName(arriving).write.option("compression", COMPRESSION).parquet(f"{root}/in")
    stream = read_arrivals(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    enrich_stream(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return read_current(spark, f"{root}/out").select("job_id", "url")


@query
def streamed(spark, sf_dir):
    """The stream's output once all postings, written as files, went through it."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    arriving = jobs(spark, sf_dir)
    arriving.write.option("compression", COMPRESSION).parquet(f"{root}/in")
    stream = read_arrivals(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    enrich_stream(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return read_current(spark, f"{root}/out").select(
        "job_id", F.col("extraction_stats.vietnamese_keywords_count").alias("n")
    )


@query
def quick_sample(spark, sf_dir):
    s = process.quick_sample(jobs(spark, sf_dir), limit=20)
    return s.select("job_id", "title", "preview", F.array_join(F.array_sort("seniority"), "|").alias("seniority"))


@query
def success_rate(spark, sf_dir):
    linkedin = jobs(spark, sf_dir).where(F.col("source") == "linkedin")
    return reports.success_rate(enrich(linkedin, min_length=20, keep_short=True))


@query
def job_details(spark, sf_dir):
    d = reports.job_details(enriched(spark, sf_dir))
    return d.select(
        *[F.array_join(c, "|").alias(c) if c.startswith("sample") else c for c in d.columns]
    )


# --- reports


@query
def statistics_facts(spark, sf_dir):
    """All that the reports count, from one pass over the enriched postings."""
    f = reports.facts(enriched(spark, sf_dir))
    return f.select("report", "key", "subkey", "n", F.round("amount", 6).alias("amount"))


@query
def overview(spark, sf_dir):
    return reports.overview(enriched(spark, sf_dir))


@query
def seniority_distribution(spark, sf_dir):
    return reports.seniority_distribution(enriched(spark, sf_dir))


@query
def category_mentions(spark, sf_dir):
    return reports.category_mentions(enriched(spark, sf_dir))


@query
def category_keyword_mentions(spark, sf_dir):
    return reports.category_keyword_mentions(enriched(spark, sf_dir))


@query
def top_keywords_per_category(spark, sf_dir):
    return reports.top_keywords_per_category(enriched(spark, sf_dir))


@query
def technology_categories(spark, sf_dir):
    return reports.category_mentions(
        enriched(spark, sf_dir), reports.EXTENDED, only_with=reports.VIETNAMESE, limit=5
    )


@query
def all_technology_categories(spark, sf_dir):
    return reports.category_mentions(enriched(spark, sf_dir), reports.EXTENDED, limit=8)


@query
def jobs_with_technologies(spark, sf_dir):
    return reports.jobs_with(enriched(spark, sf_dir))


@query
def averages(spark, sf_dir):
    a = reports.averages(enriched(spark, sf_dir))
    return a.select("total_processed", *[F.round(c, 6).alias(c) for c in a.columns[1:]])


@query
def top_skills(spark, sf_dir):
    return reports.top_items(enriched(spark, sf_dir), "extracted.skills")


@query
def top_technologies(spark, sf_dir):
    return reports.top_items(enriched(spark, sf_dir), "extracted.technologies")


@query
def keyword_combinations(spark, sf_dir):
    return reports.keyword_combinations(reports.detailed_jobs(enriched(spark, sf_dir)))


@query
def company_stats(spark, sf_dir):
    return reports.company_stats(reports.detailed_jobs(enriched(spark, sf_dir)))


@query
def detection_rates(spark, sf_dir):
    return reports.detection_rates(enriched(spark, sf_dir))


@query
def detailed_jobs(spark, sf_dir):
    d = reports.detailed_jobs(enriched(spark, sf_dir))
    return d.select(
        "job_id", "title", "company", "preview",
        F.size("vietnamese_keywords").alias("vn"), F.size("seniority_levels").alias("seniority"),
        F.size("extended_technologies").alias("technologies"),
    )


@query
def sample_jobs(spark, sf_dir):
    s = reports.sample_jobs(enriched(spark, sf_dir))
    return s.select("job_id", "title", "company", F.array_join(F.array_sort("seniority"), "|").alias("seniority"))

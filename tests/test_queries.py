"""Registered queries against their SQL on the smallest tables.

``python -m vacancylake.checks.compare SF_DIR`` does the same for all of them at any scale.
"""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vacancylake.checks.compare import connect, differences
from vacancylake.sources.postings import derived_postings

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "scan_limit", "minimum_length", "not_yet_processed", "not_yet_processed_by_shuffle", "wanted_urls_missing",
    "keyed_update", "clean_descriptions", "clean_pages", "special_characters", "normalized_text", "sections",
    "requirements_section", "rules_on_documents", "contact_info", "token_patterns", "contextual_skills",
    "dictionary_matches", "dictionary_matches_by_shuffle", "confidence_scores", "cards_topcv",
    "cards_vietnamworks", "card_applicants", "search_urls", "full_records", "run_summary", "overview",
    "seniority_distribution", "top_keywords_per_category", "keyword_combinations", "company_stats",
    "postings_from_pages", "page_descriptions", "repeated_updates", "appended_twice", "json_written", "limited_run",
    "streamed_repeats", "reprocessed", "dictionary_from_json", "enriched_with_user_dictionary", "fuzzy_by_ratio",
    "top_matches_per_job", "matches_by_score", "label_positions", "quoted_documents", "enriched_with_errors",
    "run_summary_with_errors", "records_as_postings", "rule_urls", "statistics_facts",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, con, name):
    problem, rows, _, _ = differences(spark, con, SF_DIR, name)
    assert not problem
    assert rows


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_postings_are_spread(spark):
    """As many busy partitions as asked for, however few bytes there are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        rows = derived_postings(spark, SF_DIR).select("job_id", "description")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 32 and max(sizes) < 3 * sum(sizes) / 32


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SOME) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["category", "n"]

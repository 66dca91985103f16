"""Reading and writing postings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylake.functions.text import has_text
from vacancylake.operators.joins import first_by_key
from vacancylake.schemas import POSTING

# Postings derived from the test tables.  The text runs on Spark and on other SQL engines;
# every order is a posting and every document serves as the body of some description.
DERIVED_POSTINGS_SQL = """
SELECT o.o_orderkey AS job_id,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Junior Analyst'
    WHEN 2 THEN 'Tech Lead' WHEN 3 THEN 'Fullstack Developer' WHEN 4 THEN 'Product Manager'
    ELSE 'Data Scientist' END AS title,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE c.c_name END AS company,
  n.n_name AS location,
  'https://jobs.example.org/view/' || CAST(o.o_orderkey AS STRING) AS url,
  CASE o.o_custkey % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'itviec' WHEN 2 THEN 'topcv'
    ELSE 'vietnamworks' END AS source,
  CASE o.o_custkey % 5 WHEN 0 THEN '10-15 triệu' WHEN 1 THEN '$50,000 - $70,000'
    ELSE CAST(NULL AS STRING) END AS salary,
  CASE o.o_orderkey % 7 WHEN 0 THEN CAST(o.o_orderkey % 28 + 1 AS STRING) || ' days ago'
    WHEN 1 THEN 'Reposted 2 weeks ago' WHEN 2 THEN '3 giờ trước' WHEN 3 THEN 'hôm qua'
    ELSE CAST(NULL AS STRING) END AS posted_at,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Be an early applicant'
    WHEN 1 THEN CAST(o.o_custkey % 200 AS STRING) || ' applicants'
    WHEN 2 THEN '12 people applied, ' || CAST(o.o_custkey % 90 AS STRING) || ' people clicked apply'
    WHEN 3 THEN CAST(o.o_custkey % 40 AS STRING) || ' người đã nộp'
    ELSE 'Apply now' END AS applicants_text,
  o.o_orderdate AS seen_at,
  CASE WHEN o.o_orderkey % 13 = 0 THEN CAST(NULL AS STRING)
    WHEN o.o_orderkey % 19 = 0 THEN 'too short'
    ELSE '<p>' || (CASE o.o_orderkey % 6
        WHEN 0 THEN 'Senior data engineer with 5+ years of experience in Python, SQL and AWS.'
        WHEN 1 THEN 'Junior analyst: Tableau, communication skills, 1-2 years.'
        WHEN 2 THEN 'Team lead &amp; architect; React.js, Docker, Kubernetes.'
        WHEN 3 THEN 'Fullstack: Node.js, Angular, MongoDB, CI/CD, full-time.'
        WHEN 4 THEN 'Product manager, Agile/Scrum, MBA preferred, remote.'
        ELSE 'Data scientist: machine learning, deep learning, PyTorch.' END)
      || '</p><ul><li>' || (CASE o.o_custkey % 5
        WHEN 0 THEN 'kinh nghiệm, tiếng anh, lương cạnh tranh 10-15 triệu VND'
        WHEN 1 THEN 'Salary $50,000 - $70,000 per year, hybrid'
        WHEN 2 THEN 'thực tập, bảo hiểm, phân tích dữ liệu'
        WHEN 3 THEN 'Contact hr' || CAST(o.o_custkey AS STRING)
          || '@corp.example.com or 555-123-4567, start 01/02/2024, see https://corp.example.com/jobs/'
          || CAST(o.o_orderkey AS STRING) || ' or www.example.org/careers'
        ELSE 'Reasearch in javascrpt and pythn; $25/hour; immediately' END)
      || '</li></ul>' || chr(10) || '1. ' || d.text END AS description
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM {documents}) AS doc_slot FROM {orders}) o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {documents} d ON d.doc_id = o.doc_slot
"""
DERIVED_FROM = ("orders", "customer", "nation", "documents")


def derived_postings(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """``orders`` stands in for the table where what is joined to it should be there before the texts are."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DERIVED_FROM}
    tables["orders"] = tables["orders"] if orders is None else orders
    # Narrow rows are dealt before the texts join them, since the texts' lengths differ.  The number
    # is named: without one, adaptive execution would merge the few bytes into one or two tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables["orders"] = tables["orders"].repartition(parts, "o_orderkey")
    return spark.sql(DERIVED_POSTINGS_SQL, **tables)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(path)


def as_postings(records: DataFrame) -> DataFrame:
    """Rows of any columns as postings: fields that are missing become NULL, others go."""
    return records.select(
        *[
            (F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in POSTING.fields
        ]
    )


def from_records(spark: SparkSession, records: Iterable[object]) -> DataFrame:
    """Postings from dataclass instances or dicts; missing fields become NULL."""
    rows = []
    for record in records:
        if is_dataclass(record) and not isinstance(record, type):
            record = asdict(record)
        elif not isinstance(record, dict):
            raise TypeError(f"neither a dataclass nor a dict: {type(record).__name__}")
        rows.append({f: record.get(f) for f in POSTING.fieldNames()})
    return spark.createDataFrame(rows, POSTING)


def append_postings(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def get_postings(
    postings: DataFrame, source: str | None = None, limit: int | None = None, key: str = "job_id"
) -> DataFrame:
    """Postings of one source, or the first ``limit`` of them by key."""
    if source:
        postings = postings.where(F.col("source") == source)
    return first_by_key(postings, key, limit) if limit else postings


def count_postings(postings: DataFrame, source: str | None = None) -> DataFrame:
    return get_postings(postings, source).agg(F.count("*").alias("n"))


def known_urls(postings: DataFrame) -> DataFrame:
    """Distinct non-empty urls."""
    return postings.where(has_text(F.col("url"))).select("url").distinct()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)

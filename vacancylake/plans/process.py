"""Selecting the postings to work on, running the enrichment, and writing it back."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacancylake.functions.text import has_text, longer_than, preview
from vacancylake.operators.joins import filter_members, first_by_key, lookup, may_be_broadcast, member_keys
from vacancylake.plans.enrich import (
    DONE,
    ENRICHED,
    MIN_BACKFILL_DESCRIPTION,
    MIN_DESCRIPTION,
    enrich,
)
from vacancylake.plans.reports import RUN_SUMMARY, done, run_counts, run_summary
from vacancylake.session import dropped, materialize
from vacancylake.sources.postings import known_urls
from vacancylake.sources.store import add_rows, read_current, update_rows


def select_pending(
    postings: DataFrame, processed: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Postings with a description whose url is not among the processed ones."""
    pending = postings.where(has_text(F.col("description")))
    if processed is not None:
        pending = filter_members(pending, known_urls(processed), "url", keep=False)
    return first_by_key(pending, "job_id", limit) if limit else pending


def status(min_length: int = MIN_DESCRIPTION) -> Column:
    enough = longer_than(F.col("description"), min_length)
    return F.when(enough, F.lit("processed")).otherwise(F.lit("skipped"))


def run(
    postings: DataFrame, processed: DataFrame | None = None, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Enriched pending postings, and the summary of the run.

    Both are plans; write the first and summarise what was written to compute it only once.
    """
    selected = enrich(select_pending(postings, processed, limit), keep_short=True)
    return selected.where(done()), run_summary(selected)


def _counted_write(spark: SparkSession, selected: DataFrame, write) -> DataFrame:
    """``write`` the processed rows of ``selected`` and return the summary of the run.

    The counts are taken while the rows are written, so nothing is computed or stored twice.
    """
    seen = Observation(f"run-{uuid.uuid4().hex}")
    started = datetime.now(timezone.utc)
    write(selected.observe(seen, *[c.alias(n) for n, c in run_counts().items()]).where(done()))
    ended = datetime.now(timezone.utc)
    counts = seen.get
    seconds = (ended - started).total_seconds()
    processed = counts["processed"]
    row = {
        **{n: counts[n] for n in run_counts()},
        "started_at": started,
        "ended_at": ended,
        "total_seconds": seconds,
        "avg_seconds": seconds / processed if processed else None,
    }
    return spark.createDataFrame([row], RUN_SUMMARY)


def process_all(
    spark: SparkSession, postings: DataFrame, root: str, limit: int | None = None, **options
) -> DataFrame:
    """Enrich what the store at ``root`` lacks, add it there, return the summary.

    Postings stored under their id are done too, which tells those without url.  The cost is
    that of the new postings; what is stored is read for its keys only.  ``options`` go to
    ``enrich``.
    """
    stored = read_current(spark, root)
    pending = select_pending(postings)
    if stored is not None:
        hint = "broadcast" if may_be_broadcast(stored, "job_id") else None
        pending = filter_members(pending, stored, "job_id", keep=False, hint=hint)
        # The texts only meet the urls that are there again under another id, of which there are few.
        again = filter_members(pending.select("job_id", "url"), known_urls(stored), "url", keep=True)
        again = materialize(member_keys(again, "url"), "known-again")
        pending = filter_members(pending, again, "url", keep=False)
    if limit:
        pending = first_by_key(pending, "job_id", limit)
    selected = enrich(pending, keep_short=True, **options)
    return _counted_write(spark, selected, lambda rows: add_rows(rows, root))


def reprocess(spark: SparkSession, changed: DataFrame, root: str, **options) -> DataFrame:
    """Enrich postings again and set them in the store by id; rewrites the buckets they fall into."""
    fresh = enrich(changed, keep_short=True, **options)

    def write(rows: DataFrame) -> None:
        # Written, since they are read for their keys and for their columns.
        written = materialize(rows, "fresh")
        update_rows(spark, root, changed, lambda stored: written if stored is None else merge(stored, written))
        dropped(written)

    return _counted_write(spark, fresh, write)


def merge(stored: DataFrame, fresh: DataFrame, key: str = "job_id") -> DataFrame:
    """Stored rows with fresh columns set, then the fresh rows the store lacks; one row per key.

    Of the rows that are set no more than their keys and the columns that ``fresh`` lacks are read.  All
    others only meet the keys of ``fresh``, which is read several times, and are shuffled only
    where these are too many to be sent to every task.
    """
    columns = [*stored.columns, *[c for c in fresh.columns if c not in stored.columns]]
    one = fresh.groupBy(key).agg(F.max_by(F.struct(*fresh.columns), F.to_json(F.struct(*fresh.columns))).alias("_f"))
    keys = fresh.select(F.col(key).alias("_key")).where(F.col(key).isNotNull()).distinct()
    if may_be_broadcast(fresh, key):
        keys = F.broadcast(keys)
    others = stored.join(keys, F.col(key) == F.col("_key"), "left_anti")
    kept = stored.select(F.col(key).alias("_key"), *[c for c in stored.columns if c not in fresh.columns])
    set_ = one.join(kept, F.col(key) == F.col("_key"), "left")

    def value(column: str) -> Column:
        if column == key or column not in fresh.columns:
            return F.col(column)
        return F.col(f"_f.{column}").alias(column)

    return others.select(
        *[F.col(c) if c in stored.columns else F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in columns]
    ).unionByName(set_.select(*[value(c) for c in columns]))


def process_urls(postings: DataFrame, wanted: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Enriched postings of the wanted urls, and the urls that no posting has."""
    found, missing = lookup(postings, wanted, "url")
    return enrich(found, **options), missing


def backfill(
    postings: DataFrame,
    source: str = "linkedin",
    *,
    min_length: int = MIN_BACKFILL_DESCRIPTION,
    **options,
) -> DataFrame:
    """Postings of a source not analysed yet, enriched under the shorter length limit.

    ``options`` go to ``enrich``.
    """
    todo = postings.where(F.col("source") == source)
    if "extracted" in todo.columns:
        todo = todo.where(F.col("extracted.vietnamese_keywords").isNull()).drop(*ENRICHED)
    return enrich(todo, min_length=min_length, **options)


def quick_sample(postings: DataFrame, source: str = "linkedin", limit: int = 3) -> DataFrame:
    """First unprocessed postings of a source, or processed ones when none is left.

    Results already there are shown as they are, others computed now.
    """
    postings = postings.where(F.col("source") == source)
    if DONE not in postings.columns:
        chosen = first_by_key(postings, "job_id", limit)
        return _shown(enrich(chosen, min_length=2, keep_short=True), F.lit(False))
    # Unprocessed first; processed rows only count when there are no unprocessed ones.
    first = postings.orderBy(done(), "job_id").limit(limit)
    pending = first.agg(F.count_if(~done()) > 0).first()[0]
    if not pending:
        return _shown(first, F.lit(True))
    fresh = first.where(~done()).drop(*ENRICHED)
    return _shown(enrich(fresh, min_length=2, keep_short=True), F.lit(False))


def _shown(rows: DataFrame, cached: Column) -> DataFrame:
    return rows.select(
        "job_id",
        preview(F.col("title"), 40).alias("title"),
        preview(F.col("description"), 200).alias("preview"),
        cached.alias("cached"),
        F.col("extracted.vietnamese_keywords.keyword").alias("vietnamese"),
        F.col("extracted.seniority_levels.keyword").alias("seniority"),
        F.slice(F.col("extracted.extended_technologies.keyword"), 1, 3).alias("technologies"),
    )

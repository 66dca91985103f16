"""Reports over enriched postings.

Every report is an aggregate with a partial step per partition, so a keyword, source or company
that holds most rows costs no more than others.  Ties are broken by the grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylake.functions.arrays import drop_members, non_empty, select_where, size0
from vacancylake.plans.enrich import DONE
from vacancylake.session import materialize

UNKNOWN = "Unknown"
SENIORITY = "extracted.seniority_levels"
VIETNAMESE = "extracted.vietnamese_keywords"
EXTENDED = "extracted.extended_technologies"


def done() -> Column:
    """The completion flag is set; missing counts as not set."""
    return F.coalesce(F.col(DONE), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """NULL when there is nothing to take a share of."""
    return F.try_divide(part * F.lit(100.0), whole)


def or_unknown(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(UNKNOWN))


def _members(df: DataFrame, array: str, only_with: str | None = None) -> DataFrame:
    """One row per array element, of rows whose ``only_with`` array holds any."""
    values = F.coalesce(F.col(array), F.array())
    if only_with:
        # The condition sits inside the generator: as a filter it would compute the array twice.
        values = F.when(non_empty(F.col(only_with)), values)
    return df.select(F.explode(values).alias("x"))


def _counts(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame, limit: int | None, *keys: str) -> DataFrame:
    ordered = counts.orderBy(F.desc("n"), *keys)
    return ordered.limit(limit) if limit else ordered


def overview(jobs: DataFrame, source: str | None = "linkedin") -> DataFrame:
    """Totals, coverage and detection rate of one site, or of all; every count is over the same rows."""
    jobs = jobs if source is None else jobs.where(F.col("source") == source)
    counted = jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(done()).alias("processed"),
        F.count_if(non_empty(F.col(VIETNAMESE))).alias("with_keywords"),
    )
    return counted.select(
        "*",
        percent(F.col("processed"), F.col("total_jobs")).alias("coverage"),
        percent(F.col("with_keywords"), F.col("processed")).alias("detection_rate"),
    )


def seniority_distribution(jobs: DataFrame) -> DataFrame:
    """Postings per seniority keyword and their share of postings with keywords."""
    has = non_empty(F.col(VIETNAMESE))
    # The total rides along as one more keyword, so the postings are read once.
    total = F.lit(None).cast("string")
    keywords = F.when(
        has,
        F.concat(
            F.array(total), F.transform(F.col(SENIORITY), lambda m: F.coalesce(m["keyword"], F.lit(UNKNOWN)))
        ),
    )
    counts = _counts(jobs.select(F.explode(keywords).alias("keyword")), F.col("keyword"))
    # A handful of groups, one per keyword of the dictionary.
    with_total = counts.select(
        "*", F.max(F.when(F.col("keyword").isNull(), F.col("n"))).over(Window.partitionBy()).alias("t")
    )
    return (
        with_total.where(F.col("keyword").isNotNull())
        .select("keyword", "n", percent(F.col("n"), F.col("t")).alias("share"))
        .orderBy(F.desc("n"), "keyword")
    )


def category_mentions(
    jobs: DataFrame, array: str = VIETNAMESE, only_with: str | None = None, limit: int | None = None
) -> DataFrame:
    """Mentions per keyword group."""
    x = _members(jobs, array, only_with)
    counts = _counts(x, F.coalesce("x.category", F.lit(UNKNOWN)).alias("category"))
    return _ranked(counts, limit, "category")


def category_keyword_mentions(jobs: DataFrame, array: str = VIETNAMESE) -> DataFrame:
    """Mentions per group and keyword, in group order."""
    return _keyword_counts(jobs, array).orderBy("category", "keyword")


def _keyword_counts(jobs: DataFrame, array: str) -> DataFrame:
    return _counts(
        _members(jobs, array),
        F.coalesce("x.category", F.lit(UNKNOWN)).alias("category"),
        F.coalesce("x.keyword", F.lit(UNKNOWN)).alias("keyword"),
    )


def top_keywords_per_category(jobs: DataFrame, array: str = VIETNAMESE, limit: int = 3) -> DataFrame:
    """Most mentioned keywords of each group; ranks counts, of which there is one per keyword."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "keyword"))
    ranked = _keyword_counts(jobs, array).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= limit)


def jobs_with(jobs: DataFrame, array: str = EXTENDED) -> DataFrame:
    return jobs.agg(F.count_if(non_empty(F.col(array))).alias("n"))


def averages(jobs: DataFrame) -> DataFrame:
    """Processed postings and mean counts and confidence over them."""
    return jobs.agg(
        F.count_if(done()).alias("total_processed"),
        F.avg("extraction_stats.total_skills").alias("avg_skills_count"),
        F.avg("extraction_stats.total_technologies").alias("avg_tech_count"),
        F.avg("processing.confidence_scores.ner_confidence").alias("avg_confidence"),
    )


def top_items(jobs: DataFrame, array: str, limit: int = 10) -> DataFrame:
    x = jobs.select(F.explode(F.coalesce(F.col(array), F.array())).alias("item"))
    return _ranked(_counts(x, F.col("item")), limit, "item")


def combination_key(seniority: Column, keywords: Column) -> Column:
    """Sorted seniority, then the first two of the other sorted keywords after a bar."""
    rest = F.slice(F.array_sort(drop_members(keywords, seniority)), 1, 2)
    tail = F.when(F.size(rest) > 0, F.concat(F.lit("|"), F.array_join(rest, "+")))
    return F.concat(
        F.array_join(F.array_sort(seniority), "+"), F.coalesce(tail, F.lit(""))
    )


def _names(column: str) -> Column:
    return F.coalesce(F.col(f"{column}.keyword"), F.array().cast("array<string>"))


def _picked(jobs: DataFrame) -> DataFrame:
    """The match lists as columns of their own.

    A field that is read once is all that gets computed of ``extracted``; read twice, the whole
    struct would be.
    """
    return jobs.select(
        "job_id",
        "title",
        "company",
        "description",
        F.col(VIETNAMESE).alias("vn"),
        F.col(SENIORITY).alias("sen"),
        F.col(EXTENDED).alias("ext"),
    )


def detailed_jobs(jobs: DataFrame, source: str = "linkedin", preview_length: int = 100) -> DataFrame:
    """Postings of a source with keywords, and what a reader needs to judge them."""
    return select_where(
        _picked(jobs.where(F.col("source") == source)),
        non_empty(F.col("vn")) & F.col("sen").isNotNull(),
        "job_id",
        "title",
        "company",
        F.substring("description", 1, preview_length).alias("preview"),
        _names("vn").alias("vietnamese_keywords"),
        _names("sen").alias("seniority_levels"),
        _names("ext").alias("extended_technologies"),
    )


def keyword_combinations(detailed: DataFrame, limit: int | None = 10) -> DataFrame:
    key = combination_key(F.col("seniority_levels"), F.col("vietnamese_keywords"))
    return _ranked(_counts(detailed, key.alias("combination")), limit, "combination")


def company_stats(detailed: DataFrame, limit: int | None = 5) -> DataFrame:
    """Companies by the keywords in their postings."""
    stats = detailed.groupBy(or_unknown("company").alias("company")).agg(
        F.count("*").alias("jobs"),
        F.sum(size0(F.col("vietnamese_keywords"))).alias("vn_keywords"),
    )
    ordered = stats.withColumn(
        "avg_keywords", F.try_divide(F.col("vn_keywords").cast("double"), F.col("jobs"))
    ).orderBy(F.desc("vn_keywords"), "company")
    return ordered.limit(limit) if limit else ordered


def detection_rates(jobs: DataFrame) -> DataFrame:
    """Shares of processed postings with seniority, extended technologies and keywords."""
    processed = F.count_if(done())
    # Picked first, since the whole struct would be computed for fields read in an aggregate.
    found = jobs.select(
        DONE, *[non_empty(F.col(c)).alias(n) for n, c in (("sen", SENIORITY), ("ext", EXTENDED), ("vn", VIETNAMESE))]
    )
    return found.agg(
        percent(F.count_if("sen"), processed).alias("seniority_rate"),
        percent(F.count_if("ext"), processed).alias("extended_rate"),
        percent(F.count_if("vn"), processed).alias("vietnamese_rate"),
    )


RUN_SUMMARY = (
    "processed long, skipped long, errors long, vietnamese_detected long, seniority_detected long, "
    "extended_tech_detected long, started_at timestamp, ended_at timestamp, total_seconds double, avg_seconds double"
)


def _outcomes() -> dict[str, Column]:
    """Whether a row that a run selected is done or failed, and what was detected in it.

    An error is a posting that a guard of the enrichment kept from being processed.
    """
    detected = {"vietnamese_detected": VIETNAMESE, "seniority_detected": SENIORITY, "extended_tech_detected": EXTENDED}
    return {
        "processed": done(),
        "errors": F.col("processing.error").isNotNull(),
        **{name: non_empty(F.col(array)) for name, array in detected.items()},
    }


def _counted(outcomes: dict[str, Column]) -> dict[str, Column]:
    skipped = ~outcomes["processed"] & ~outcomes["errors"]
    held = {"processed": outcomes["processed"], "skipped": skipped, **outcomes}
    return {name: F.count_if(c) for name, c in held.items()}


def run_counts() -> dict[str, Column]:
    """Aggregates over the rows a run selected: outcomes, and detections among the processed."""
    return _counted(_outcomes())


def run_summary(jobs: DataFrame) -> DataFrame:
    """What a run over these postings did: rows processed, skipped and failed, and detections."""
    # Picked first, as in ``detection_rates``.
    each = jobs.select(*[c.alias(name) for name, c in _outcomes().items()])
    return each.agg(*[c.alias(name) for name, c in _counted({n: F.col(n) for n in each.columns}).items()])


def success_rate(jobs: DataFrame) -> DataFrame:
    counted = jobs.agg(F.count_if(done()).alias("updated"), F.count("*").alias("selected"))
    return counted.select(
        "*", percent(F.col("updated"), F.col("selected")).alias("success_rate")
    )


def job_details(jobs: DataFrame) -> DataFrame:
    """A line per processed posting: how much was extracted, with samples."""
    e = "extracted"
    return jobs.where(done()).select(
        "job_id",
        or_unknown("title").alias("title"),
        or_unknown("company").alias("company"),
        *[
            size0(F.col(f"{e}.{f}")).alias(f"{f}_count")
            for f in (
                "skills", "technologies", "roles", "responsibilities",
                "vietnamese_keywords", "seniority_levels", "extended_technologies",
            )
        ],
        F.slice(_names(VIETNAMESE), 1, 3).alias("sample_vietnamese"),
        F.slice(_names(SENIORITY), 1, 2).alias("sample_seniority"),
    )


TOTAL_FIELDS = [
    "skills", "technologies", "roles", "responsibilities", "qualifications",
    "emails", "urls", "phone_numbers",
]


def total_extractions() -> Column:
    total = F.lit(0)
    for field in TOTAL_FIELDS:
        total = total + size0(F.col(f"extracted.{field}"))
    return total


def extraction_summary(extracted: Column, fields: list[str]) -> Column:
    """A ``<field>_count`` per list field."""
    return F.struct(*[size0(extracted[f]).alias(f"{f}_count") for f in fields])


def sample_jobs(jobs: DataFrame, limit: int = 3) -> DataFrame:
    """First postings with keywords, for a look."""
    shown = select_where(
        _picked(jobs),
        non_empty(F.col("vn")),
        "job_id",
        F.substring("title", 1, 40).alias("title"),
        F.substring(or_unknown("company"), 1, 30).alias("company"),
        F.slice(_names("vn"), 1, 4).alias("vietnamese"),
        _names("sen").alias("seniority"),
        F.slice(_names("ext"), 1, 5).alias("technologies"),
    )
    return shown.orderBy("job_id").limit(limit)


def facts(jobs: DataFrame, source: str = "linkedin") -> DataFrame:
    """``(report, key, subkey, n, amount)``: all that the reports count and add up, from one pass.

    Every posting lists its facts, and one aggregate with a partial step per partition counts them;
    what is left is a row per keyword, category, company or combination.  Combinations and companies
    are those of one ``source``.
    """
    none = F.lit(None).cast("string")
    rows = jobs.select(
        "source", "company", done().alias("done"),
        F.coalesce(F.col(VIETNAMESE), F.array()).alias("vn"),
        F.col(SENIORITY).alias("sen"),
        F.coalesce(F.col(EXTENDED), F.array()).alias("ext"),
        F.col("extracted.skills").alias("skills"),
        F.col("extracted.technologies").alias("technologies"),
        F.col("extraction_stats.total_skills").alias("n_skills"),
        F.col("extraction_stats.total_technologies").alias("n_technologies"),
        F.col("processing.confidence_scores.ner_confidence").alias("confidence"),
    )

    def fact(report: str, key: Column = none, subkey: Column = none, amount: Column = F.lit(0.0)) -> Column:
        return F.struct(
            F.lit(report).alias("report"), key.alias("key"), subkey.alias("subkey"), amount.cast("double").alias("amount")
        )

    def once(condition: Column, value: Column) -> Column:
        return F.when(condition, F.array(value))

    def each(values: Column, make) -> Column:
        return F.transform(values, make)

    def known(match: Column, field: str) -> Column:
        return F.coalesce(match[field], F.lit(UNKNOWN))

    names = lambda c: F.coalesce(F.col(c)["keyword"], F.array().cast("array<string>"))
    has_vn, detailed = F.size("vn") > 0, (F.col("source") == source) & (F.size("vn") > 0) & F.col("sen").isNotNull()
    of_source = {"total": F.lit(True), "processed": F.col("done"), "vietnamese": has_vn,
                 "seniority": non_empty(F.col("sen")), "extended": F.size("ext") > 0}
    values = {"skills": "n_skills", "technologies": "n_technologies", "confidence": "confidence"}
    lists = [
        *[once(c, fact("jobs", F.col("source"), F.lit(n))) for n, c in of_source.items()],
        *[once(F.col(c).isNotNull(), fact("average", F.lit(n), amount=F.col(c))) for n, c in values.items()],
        each(F.col("vn"), lambda m: fact("vietnamese", known(m, "category"), known(m, "keyword"))),
        F.when(has_vn, each(F.col("sen"), lambda m: fact("seniority", known(m, "keyword")))),
        each(F.col("ext"), lambda m: fact("extended", known(m, "category"))),
        F.when(has_vn, each(F.col("ext"), lambda m: fact("extended_with_vietnamese", known(m, "category")))),
        each(F.col("skills"), lambda item: fact("skills", item)),
        each(F.col("technologies"), lambda item: fact("technologies", item)),
        once(detailed, fact("combination", combination_key(names("sen"), names("vn")))),
        once(detailed, fact("company", or_unknown("company"), amount=F.size("vn"))),
    ]
    every = F.flatten(F.array(*[F.coalesce(x, F.array()) for x in lists]))
    listed = rows.select(F.explode(every).alias("f")).select("f.*")
    return listed.groupBy("report", "key", "subkey").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def statistics(jobs: DataFrame, source: str = "linkedin") -> dict[str, DataFrame]:
    """All reports by name; the postings are read once for all that is counted, and once for the sample."""
    counted = materialize(facts(jobs, source), "facts")

    def of(report: str) -> DataFrame:
        return counted.where(F.col("report") == report)

    def counts(report: str, name: str, limit: int | None) -> DataFrame:
        rows = of(report).groupBy(F.col("key").alias(name)).agg(F.sum("n").alias("n"))
        return _ranked(rows, limit, name)

    def sums(rows: DataFrame) -> DataFrame:
        number = lambda n: F.coalesce(F.sum(F.when(F.col("subkey") == n, F.col("n"))), F.lit(0))
        return rows.agg(*[number(n).alias(n) for n in ("total", "processed", "vietnamese", "seniority", "extended")])

    every, site = sums(of("jobs")), sums(of("jobs").where(F.col("key") == source))
    total, processed, found = F.col("total"), F.col("processed"), F.col("vietnamese")
    with_keywords = every.select(found.alias("t"))
    mean = lambda n: F.try_divide(
        F.sum(F.when(F.col("key") == n, F.col("amount"))), F.sum(F.when(F.col("key") == n, F.col("n")))
    )
    ranked = of("vietnamese").select(F.col("key").alias("category"), F.col("subkey").alias("keyword"), "n").withColumn(
        "rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "keyword"))
    )
    companies = of("company").select(F.col("key").alias("company"), F.col("n").alias("jobs"), F.col("amount").cast("long").alias("vn_keywords"))
    return {
        "overview": site.select(
            total.alias("total_jobs"), "processed", found.alias("with_keywords"),
            percent(processed, total).alias("coverage"), percent(found, processed).alias("detection_rate"),
        ),
        "seniority": counts("seniority", "keyword", None).join(F.broadcast(with_keywords)).select(
            "keyword", "n", percent(F.col("n"), F.col("t")).alias("share")
        ).orderBy(F.desc("n"), "keyword"),
        "categories": counts("vietnamese", "category", None),
        "top_keywords": ranked.where("rank <= 3"),
        "technology_categories": counts("extended_with_vietnamese", "category", 8),
        "all_technology_categories": counts("extended", "category", 8),
        "jobs_with_technologies": every.select(F.col("extended").alias("n")),
        "averages": of("average").agg(
            mean("skills").alias("avg_skills_count"), mean("technologies").alias("avg_tech_count"), mean("confidence").alias("avg_confidence")
        ).join(F.broadcast(every.select(processed.alias("total_processed")))),
        "top_skills": counts("skills", "item", 10),
        "top_technologies": counts("technologies", "item", 10),
        "combinations": counts("combination", "combination", 10),
        "companies": companies.withColumn("avg_keywords", F.try_divide(F.col("vn_keywords").cast("double"), F.col("jobs")))
        .orderBy(F.desc("vn_keywords"), "company").limit(5),
        "detection_rates": every.select(
            percent(F.col("seniority"), processed).alias("seniority_rate"),
            percent(F.col("extended"), processed).alias("extended_rate"),
            percent(found, processed).alias("vietnamese_rate"),
        ),
        "sample": sample_jobs(jobs),
    }

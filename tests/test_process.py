from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from vacancylake.plans import reports
from vacancylake.plans.enrich import DONE, enrich, full_record, text_guards
from vacancylake.plans.process import backfill, merge, process_all, process_urls, quick_sample, reprocess, run, select_pending
from vacancylake.schemas import POSTING
from vacancylake.sources.postings import append_postings, as_postings, from_records, get_postings, read_postings, write_json
from vacancylake.sources.store import BUCKETS, read_current, touched_buckets

TEXT = "Senior engineer with 5+ years of experience in Python and AWS. "


def posting(n, description=TEXT, source="linkedin", url="auto", company="c", title="t"):
    return {
        "job_id": n, "title": title, "company": company, "source": source, "description": description,
        "url": f"https://x/{n}" if url == "auto" else url,
    }


@pytest.fixture
def postings(spark):
    return from_records(
        spark,
        [
            posting(1),
            posting(2, TEXT + "thực tập, tiếng anh, bảo hiểm, team lead, remote, devops", company=None),
            posting(3, "short one"),
            posting(4, None),
            posting(5, "", source="topcv"),
            posting(6, TEXT + "senior devops, bảo hiểm", source="topcv"),
            posting(7, TEXT, url=None),
            posting(8, "an intern, between limits"),
        ],
    )


def test_records(spark):
    @dataclass
    class Posting:
        title: str
        job_id: int
        tags: list

    df = from_records(spark, [Posting("a", 1, ["x"]), {"title": "b"}])
    assert df.schema == POSTING
    assert [(r.title, r.job_id, r.tags) for r in df.collect()] == [("a", 1, ["x"]), ("b", None, None)]
    with pytest.raises(TypeError):
        from_records(spark, ["text"])


def test_files(spark, postings, tmp_path):
    path = str(tmp_path / "p")
    append_postings(postings, path)
    append_postings(postings.limit(0), path)
    stored = read_postings(spark, path)
    assert stored.count() == 8
    assert [r.job_id for r in get_postings(stored, "topcv", 1).collect()] == [5]
    write_json(full_record(enrich(stored)), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_pending(spark, postings):
    done = postings.where("job_id = 2")
    assert {r.job_id for r in select_pending(postings, done).collect()} == {1, 3, 6, 7, 8}
    assert sorted(r.job_id for r in select_pending(postings, done, 2).collect()) == [1, 3]
    enriched, summary = run(postings, done)
    assert {r.job_id for r in enriched.collect()} == {1, 6, 7}
    assert summary.first().asDict() == {
        "processed": 3, "skipped": 2, "errors": 0, "vietnamese_detected": 3, "seniority_detected": 3, "extended_tech_detected": 3,
    }


def test_short_rows_stay_empty(postings):
    rows = {r.job_id: r for r in enrich(postings, keep_short=True).collect()}
    assert len(rows) == 8
    assert rows[3][DONE] is None and rows[3].description_cleaned is None
    assert rows[3].extracted.skills is None and rows[3].extracted.matched_skills is None
    assert rows[3].extraction_stats.total_skills is None
    assert rows[1][DONE] and rows[1].extraction_stats.total_skills == 1
    assert rows[1].processing.confidence_scores.total_matches > 0


def test_process_all_adds_what_is_new(spark, postings, tmp_path):
    root = str(tmp_path / "store")
    assert read_current(spark, root) is None
    first = process_all(spark, postings.where("job_id < 5"), root).first()
    assert (first.processed, first.skipped, first.errors) == (2, 1, 0)
    assert first.ended_at >= first.started_at and first.avg_seconds == first.total_seconds / 2
    second = process_all(spark, postings, root).first()
    assert (second.processed, second.skipped) == (2, 2)
    assert sorted(r.job_id for r in read_current(spark, root).collect()) == [1, 2, 6, 7]
    third = process_all(spark, postings, root).first()
    assert (third.processed, third.skipped) == (0, 2)  # the too short ones
    assert read_current(spark, root).count() == 4


def test_limit_counts_new_postings(spark, postings, tmp_path):
    root = str(tmp_path / "store")
    for wanted in ([1], [1, 2], [1, 2]):
        process_all(spark, postings.where("job_id in (1, 2)"), root, limit=1)
        assert sorted(r.job_id for r in read_current(spark, root).collect()) == wanted


def files_of(root):
    return {p.relative_to(root).as_posix() for p in root.glob("bucket=*/*.parquet")}


def test_reprocess(spark, postings, tmp_path):
    """Only the partitions that the changed ids fall into are written anew."""
    root = tmp_path / "store"
    process_all(spark, postings.where("job_id < 5"), str(root))
    changed = from_records(spark, [posting(1, TEXT + "Kotlin"), posting(9)])
    before, touched = files_of(root), touched_buckets(changed)
    summary = reprocess(spark, changed.unionByName(changed.where("job_id = 1")), str(root)).first()
    assert summary.processed == 3 and len(touched) == 2
    same = {f for f in before if f.split("/")[0] not in {f"bucket={b}" for b in touched}}
    assert same and same == before & files_of(root)
    skills = {r.job_id: r.s for r in read_current(spark, str(root)).select(
        "job_id", F.col("extracted.matched_skills.keyword").alias("s")).collect()}
    assert skills == {1: ["python", "kotlin"], 2: ["python"], 9: ["python"]}


def test_reprocess_into_an_empty_store(spark, tmp_path):
    root = str(tmp_path / "store")
    reprocess(spark, from_records(spark, [posting(1), posting(2, "short")]), root)
    assert [r.job_id for r in read_current(spark, root).collect()] == [1]


def test_runs_without_rows_and_broken_files(spark, postings, tmp_path):
    root = tmp_path / "store"
    process_all(spark, postings.where("job_id = 3"), str(root))  # too short, so nothing is stored
    assert read_current(spark, str(root)) is None
    process_all(spark, postings.where("job_id = 1"), str(root))
    assert read_current(spark, str(root)).count() == 1
    assert all(0 <= int(f.split("/")[0].split("=")[1]) < BUCKETS for f in files_of(root))
    (root / "bucket=0").mkdir(exist_ok=True)
    (root / "bucket=0" / "part-bad.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        process_all(spark, postings, str(root))  # not taken for an empty table


def test_rows_that_fail_are_kept_with_their_reason(spark, postings, tmp_path):
    long, broken = TEXT * 20, "concat(repeat('Python and AWS, tiếng anh. ', 4), cast(X'ff41' as string))"
    more = from_records(spark, [posting(20, long), posting(21)]).withColumn("description", F.expr(f"if(job_id = 21, {broken}, description)"))
    every = postings.unionByName(more)
    guards = text_guards(500)
    rows = {r.job_id: r for r in enrich(every, keep_short=True, guards=guards).collect()}
    assert {i: r.processing.error for i, r in rows.items() if r.processing.error} == {20: "too_long", 21: "invalid_utf8"}
    for i in (20, 21):
        assert rows[i][DONE] is None and rows[i].description_cleaned == "" and rows[i].processing.processed_at is None
        assert rows[i].extracted.skills == [] and rows[i].extracted.matched_skills == [] and rows[i].extracted.emails == []
        assert rows[i].extraction_stats.total_skills == 0 and rows[i].extraction_stats.text_length_original > 100
    plain = {r.job_id: r for r in enrich(postings, keep_short=True).collect()}
    assert all(rows[i].extracted == r.extracted and rows[i][DONE] == r[DONE] for i, r in plain.items())
    assert {r.job_id for r in enrich(every, guards=guards).collect()} == {1, 2, 6, 7, 20, 21}
    root = str(tmp_path / "store")
    first = process_all(spark, every, root, guards=guards).first()
    assert (first.processed, first.skipped, first.errors) == (4, 2, 2)
    assert sorted(r.job_id for r in read_current(spark, root).collect()) == [1, 2, 6, 7]
    again = process_all(spark, every, root, guards={}).first()  # they are still pending
    assert (again.processed, again.errors) == (2, 0)


def test_rows_of_any_columns_as_postings(spark):
    df = as_postings(spark.createDataFrame([("7", "a", 1.5)], "job_id string, title string, other double"))
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in POSTING]
    assert [(r.job_id, r.title, r.tags) for r in df.collect()] == [(7, "a", None)]


def test_urls(spark, postings):
    wanted = spark.createDataFrame([("https://x/1",), ("https://x/3",), ("https://x/99",)], "url string")
    done, missing = process_urls(postings, wanted)
    assert [r.job_id for r in done.collect()] == [1]
    assert [r.url for r in missing.collect()] == ["https://x/99"]


def test_backfill(postings):
    assert {r.job_id for r in backfill(postings).collect()} == {1, 2, 7, 8}
    partly = enrich(postings, keep_short=True)
    rest = backfill(partly)
    assert [r.job_id for r in rest.collect()] == [8]
    assert rest.columns.count("extracted") == 1


def test_quick_sample(postings):
    fresh = quick_sample(postings, limit=2).collect()
    assert [(r.job_id, r.cached) for r in fresh] == [(1, False), (2, False)]
    state = enrich(postings, keep_short=True)
    assert [r.job_id for r in quick_sample(state).collect()] == [3, 4, 8]
    cached = quick_sample(state.where(DONE)).collect()
    assert [(r.job_id, r.cached) for r in cached] == [(1, True), (2, True), (7, True)]
    assert cached[0].seniority == ["senior"]


def test_reports(postings):
    state = enrich(postings, keep_short=True).cache()
    stats = reports.statistics(state)
    assert stats["overview"].first().asDict() == {
        "total_jobs": 6, "processed": 3, "with_keywords": 3, "coverage": 50.0, "detection_rate": 100.0,
    }
    seniority = {r.keyword: (r.n, r.share) for r in stats["seniority"].collect()}
    assert seniority == {"senior": (4, 100.0), "lead": (1, 25.0), "fresher": (1, 25.0)}
    companies = [(r.company, r.jobs) for r in stats["companies"].collect()]
    assert companies == [("Unknown", 1), ("c", 2)]
    assert stats["sample"].count() == 3
    assert all(df.columns for df in stats.values())
    empty = state.limit(0)
    assert reports.overview(empty).first().coverage is None
    assert reports.detection_rates(empty).first().seniority_rate is None
    assert reports.seniority_distribution(empty).count() == 0


def test_bundle_equals_the_single_reports(postings):
    more = postings.unionByName(postings.withColumn("job_id", F.col("job_id") + 100).withColumn("source", F.lit("itviec")))
    state = enrich(more, keep_short=True).cache()
    detailed = reports.detailed_jobs(state)
    single = {
        "overview": reports.overview(state), "seniority": reports.seniority_distribution(state),
        "categories": reports.category_mentions(state), "top_keywords": reports.top_keywords_per_category(state),
        "technology_categories": reports.category_mentions(state, reports.EXTENDED, only_with=reports.VIETNAMESE, limit=8),
        "all_technology_categories": reports.category_mentions(state, reports.EXTENDED, limit=8),
        "jobs_with_technologies": reports.jobs_with(state), "averages": reports.averages(state),
        "top_skills": reports.top_items(state, "extracted.skills"), "top_technologies": reports.top_items(state, "extracted.technologies"),
        "combinations": reports.keyword_combinations(detailed), "companies": reports.company_stats(detailed),
        "detection_rates": reports.detection_rates(state),
    }
    for bundle, frame in ((reports.statistics(state), state), (reports.statistics(state.limit(0)), None)):
        for name, want in single.items():
            got = bundle[name]
            assert sorted(got.columns) == sorted(want.columns), name
            if frame is not None:
                rows = [[pytest.approx(r[c]) if isinstance(r[c], float) else r[c] for c in want.columns] for r in want.collect()]
                assert [[r[c] for c in want.columns] for r in got.collect()] == rows, name
    sources = lambda df: df._jdf.queryExecution().analyzed().toString().count("LogicalRDD")
    assert sources(reports.facts(state)) == sources(state)  # one read of the frame


def test_combination_key(spark):
    df = spark.createDataFrame(
        [
            (["senior", "lead"], ["senior", "lead", "remote", "devops", "bảo hiểm"]),
            (["senior"], ["senior"]),
            ([], ["b", "a", "a"]),
        ],
        "s array<string>, v array<string>",
    )
    got = [r.k for r in df.select(reports.combination_key(F.col("s"), F.col("v")).alias("k")).collect()]
    assert got == ["lead+senior|bảo hiểm+devops", "senior", "|a+a"]


def test_reports_of_some_fields_run_no_rules(spark):
    """Two or more fields read in one report must not bring the patterns of all others into the plan."""
    postings = spark.createDataFrame([(1, "t", "c", "linkedin", "Senior engineer with Python, tiếng anh and Docker, at least fifty signs")],
                                     "job_id long, title string, company string, source string, description string")
    enriched = enrich(postings, keep_short=True)
    for report in (reports.detection_rates, reports.run_summary, reports.detailed_jobs):
        plan = report(enriched)._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan
    assert reports.detection_rates(enriched).first().asDict() == {
        "seniority_rate": 100.0, "extended_rate": 100.0, "vietnamese_rate": 100.0
    }
    counts = reports.run_summary(enriched).first()
    assert (counts.processed, counts.skipped, counts.errors, counts.vietnamese_detected) == (1, 0, 0, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merge_leaves_other_rows_in_place(spark):
    """Stored rows meet keys alone, none is sorted for a join, and keys may repeat or be missing."""
    stored = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z"), (None, "d", "w")], "job_id long, text string, old string")
    fresh = spark.createDataFrame([(1, "e", 5), (1, "f", 6), (3, "g", 7), (None, "h", 8)], "job_id long, text string, new int")
    got = merge(stored, fresh)
    assert got.columns == ["job_id", "text", "old", "new"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "f", "x", 6), (1, "f", "y", 6), (2, "c", "z", None), (3, "g", None, 7), (None, "d", "w", None), (None, "h", None, 8),
    ]))
    assert "FullOuter" not in plan_of(got) and "LeftAnti" in plan_of(got)


def test_facts_compute_no_rules(postings):
    """Counters are read without all that lies beside them."""
    plan = plan_of(reports.facts(enrich(postings, keep_short=True)))
    assert "_skills#" in plan and "_emails#" not in plan and "_dates#" not in plan


def test_texts_meet_keys_without_a_shuffle(spark, postings, tmp_path, monkeypatch):
    """A later run sends stored ids, and urls that are there again, to the postings."""
    from vacancylake.plans import process

    root, plans = str(tmp_path / "store"), []
    process_all(spark, postings.where("job_id = 2"), root)
    add = process.add_rows
    monkeypatch.setattr(process, "add_rows", lambda rows, root: plans.append(rows._jdf.queryExecution().sparkPlan().toString()) or add(rows, root))
    twin = postings.where("job_id = 2").withColumn("job_id", F.lit(99).cast("long"))
    process_all(spark, postings.unionByName(twin), root)
    assert sorted(r.job_id for r in read_current(spark, root).collect()) == [1, 2, 6, 7]
    assert "BroadcastHashJoin [job_id" in plans[0] and "known-again" in plans[0] and "SortMergeJoin" not in plans[0]

import pytest
from pyspark.sql import functions as F

from vacancylake.operators.joins import filter_members, first_by_key, lookup, update_by_key


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one url, a tenth have none."""
    return spark.range(900).select(
        F.col("id").alias("job_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
        .alias("url"),
    )


@pytest.mark.parametrize("hint", [None, "broadcast", "merge"])
def test_hot_and_missing_keys(spark, rows, hint):
    keys = spark.createDataFrame([("hot",), ("u2",), ("u2",), (None,), ("absent",)], "url string")
    out = filter_members(rows, keys, "url", keep=False, hint=hint)
    kept = filter_members(rows, keys, "url", keep=True, hint=hint)
    wanted = {r.job_id for r in rows.collect() if r.url not in ("hot", "u2")}
    assert {r.job_id for r in out.collect()} == wanted
    assert kept.count() == 301
    assert out.columns == rows.columns == kept.columns


def test_lookup(spark, rows):
    wanted = spark.createDataFrame([("u2",), ("absent",), ("u4",)], "url string")
    found, missing = lookup(rows, wanted, "url")
    assert {r.url for r in found.collect()} == {"u2", "u4"}
    assert [r.url for r in missing.collect()] == ["absent"]


def test_update_by_key(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "c", "z")], "k long, v string, w string")
    new = spark.createDataFrame([(2, "B", True), (9, "N", True), (None, "M", True)], "k long, v string, flag boolean")
    got = {tuple(r) for r in update_by_key(base, new, "k").collect()}
    assert got == {(1, "a", "x", None), (2, "B", None, True), (None, "c", "z", None)}
    only = update_by_key(base, new, "k", ["flag"])
    assert {tuple(r) for r in only.collect()} == {(1, "a", "x", None), (2, "b", None, True), (None, "c", "z", None)}


def test_one_row_per_updated_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 3), (1, "y", 3)], "k long, v string, at int")
    assert sorted(tuple(r) for r in update_by_key(base, new, "k", ["v"], latest="at").collect()) == [(1, "x"), (2, "b")]
    assert sorted(tuple(r) for r in update_by_key(base, new, "k", ["v"]).collect()) == [(1, "y"), (2, "b")]


def test_membership_takes_no_job_and_shuffles_no_large_side_twice(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    filter_members(rows, rows, "url", keep=False)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_first_by_key(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7 % 1000).alias("k"), F.lit("t").alias("t"))
    first = first_by_key(df, "k", 250)
    assert sorted(r.k for r in first.collect()) == list(range(250))
    assert len({r.p for r in first.select(F.spark_partition_id().alias("p")).collect()}) >= 7
    tied = spark.createDataFrame([(1,), (1,), (1,), (None,), (2,), (None,)], "k long")
    count = lambda n: sorted((str(r.k) for r in first_by_key(tied, "k", n).collect()))
    assert [count(n) for n in (2, 4, 5, 9)] == [
        ["1", "1"], ["1", "1", "1", "2"], ["1", "1", "1", "2", "None"], ["1", "1", "1", "2", "None", "None"],
    ]
    assert first_by_key(tied.limit(0), "k", 3).count() == 0


def test_update_can_clear_a_value(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, None)], "k long, v string")
    assert update_by_key(base, new, "k").first().v is None

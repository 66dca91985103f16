import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_fuzzy_lines import brute_force as lines_by_brute_force
from tests.llm.test_ngram_join import brute_force as links_by_brute_force

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and every stage's rows over part of the smallest table and some odd rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(90)
    odd = spark.createDataFrame(
        [(5000, None, "en", None, None), (5001, "", "en", "s", 0), (5002, "!! 12", None, "s", 5), (None, "The and the of the.", "en", "s", 19)],
        docs.schema,
    )
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(3)
    leaked = leak.select(
        (F.col("item_id") + 6000).alias("doc_id"), F.upper("text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")
    )
    docs = docs.unionByName(odd).unionByName(leaked).unionByName(docs.limit(2)).repartition(3)
    out = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_language_stage_keeps_what_has_a_language(stages):
    kept = {r[0] for r in rows(stages[1])}
    assert not kept & {5000, 5001, 5002}
    assert len(rows(stages[1])) >= len(rows(stages[0])) - 6


def test_line_stage(spark, stages):
    want, _ = lines_by_brute_force(spark, rows(stages[1]))
    assert sorted(rows(stages[2]), key=str) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_copy_stage(stages):
    before = rows(stages[2])
    heads = {c if c is not None else d for d, c, _ in links_by_brute_force(before)}
    ids = [d for d, _ in rows(stages[3])]
    assert set(ids) == heads and len(ids) == len(set(ids))


def test_decontamination_stage(stages):
    before, after = {d for d, _ in rows(stages[3])}, {d for d, _ in rows(stages[4])}
    assert {6000, 6001, 6002} & before and not {6000, 6001, 6002} & after
    bench = [" ".join(r.text.lower().split()) for r in stages[0].sparkSession.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {d for d, t in rows(stages[3]) if any(b in " ".join((t or "").lower().split()) for b in bench)}
    assert held <= before - after
    assert len(before - after) <= len(held) + 5


def test_packing_stage(stages):
    assert {r.doc_id for r in stages[5].collect()} == {d for d, _ in rows(stages[4])}


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and got.count() > 50

from pyspark.sql import functions as F

from vacancylake.functions import spotting
from vacancylake.functions.text import clean
from vacancylake.operators.term_match import TermIndex


def test_substring_mode_on_the_demo(value, demo):
    got = {k: value(lambda t, k=k: spotting.substrings(clean(t), k), demo) for k in spotting.SUBSTRINGS}
    assert got["skills"] == ["python", "machine learning", "data science", "sql", "git", "docker", "aws",
                             "azure", "communication"]
    assert got["roles"] == ["engineer", "scientist", "senior"]
    assert got["technologies"] == ["docker", "aws", "azure", "git"]


def test_context_phrases(value):
    given = ("Experience with Spark, Kafka; Hive and Oozie, Flink. Knowledge of the, C! "
             "Skilled in writing? Expert in go and sql.")
    assert value(spotting.contextual_skills, given) == ["spark", "kafka", "hive", "writing?", "sql"]
    assert value(spotting.contextual_skills, "nothing") == []
    assert value(spotting.contextual_skills, None) == []


def test_labels_in_text_order(spark):
    index = TermIndex.builtin()
    text = "Data Scientist or software engineer; manage Docker, React JS. Years experience; c++"
    df = spark.createDataFrame([(text,)], "t string")
    m = df.select(index.match(F.col("t")).alias("m")).first().m
    assert m.label_roles == ["data scientist", "scientist", "software engineer", "engineer"]
    assert m.label_technologies == ["docker", "react", "react js"]
    assert m.label_skills == ["c++"]
    assert m.label_responsibilities == ["manage"]
    assert m.label_qualifications == ["years experience"]


def test_confidence(spark):
    df = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("x"), F.array().cast("array<string>").alias("y"))
    got = df.select(spotting.pattern_confidence([F.col("x"), F.col("y")]).alias("c")).first().c
    assert abs(got - (0.2 + 1 / 6 * 0.2)) < 1e-12
    assert df.select(spotting.pattern_confidence([F.col("y")]).alias("c")).first().c == 0


def test_substrings_in_batches(spark):
    df = spark.createDataFrame([(0, "KUBERNETES and Kubernetes, gİt, Java"), (1, None), (2, "")], "i int, t string").coalesce(1)
    found = df.select("i", spotting.substrings(F.col("t"), "skills").alias("s"))
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.s for r in found.orderBy("i").collect()] == [["java", "kubernetes"], [], []]

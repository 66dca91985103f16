import re

import pytest
from pyspark.sql import functions as F

from vacancylake.functions import rules
from vacancylake.functions.text import clean


@pytest.mark.parametrize(
    "kind, given, wanted",
    [
        ("dates", "January 15, 2024", []),
        ("dates", "from Jan 2024, 01/02/2024 and 3.4.2025; ASAP", ["01/02/2024", "3.4.2025", "Jan 2024", "ASAP"]),
        ("dates", "within 2 weeks", ["within 2 weeks"]),
        ("durations", "5+ years of experience", ["5+ years of experience", "5+ years"]),
        ("durations", "2 – 5 years; 6 month contract", ["2 – 5 years", "5 years", "6 month contract"]),
        ("emails", "a.b+c@x-y.co.uk, a.b+c@x-y.co.uk", ["a.b+c@x-y.co.uk"]),
        ("urls", "see https://www.x.org/a?b=1 now", ["https://www.x.org/a?b=1", "www.x.org/a?b=1"]),
        ("phone_numbers", "(555) 123-4567", ["(555)-123-4567"]),
        ("phone_numbers", "555 123 4567", ["555-123-4567"]),
        ("phone_numbers", "+84-901-234-567 or 0901234567", ["0901234567", "+84-901-234-567"]),
        ("salaries", "10-15 TRIỆU VND", ["10-15 TRIỆU VND"]),
        ("salaries", "$50K - $70K", ["$50", "$70", "$50K - $70K"]),
        ("salaries", "$50,000 - $70,000 per year", ["$50,000 - $70,000 per year"]),
        ("work_arrangements", "Full-Time, REMOTE or work from home", ["remote", "work from home", "full-time"]),
        ("work_arrangements", "contemporary offices", []),
        ("education_levels", "as a lead, master's degree", ["master's degree"]),
        ("education_levels", "as a lead with a master's in maths", ["master's"]),
        ("education_levels", "BA degree, PhD and high  school", ["ba degree", "phd", "high  school"]),
        ("education_levels", "résumés and Mai", []),
        ("emails", None, []),
    ],
)
def test_hits(value, kind, given, wanted):
    assert value(lambda t: rules.extract(t, kind), given) == wanted


def test_demo(value, demo):
    got = {
        kind: value(lambda t, kind=kind: rules.extract(clean(t), kind), demo) for kind in rules.RULES
    }
    assert got["dates"] == []
    assert got["durations"] == ["5+ years of experience", "5+ years"]
    assert got["emails"] == ["careers@company.com"]
    assert got["urls"] == ["www.company.com/careers"]
    assert got["phone_numbers"] == ["(555)-123-4567"]
    assert got["salaries"] == ["$120,000 - $150,000 per year"]


def test_shortcuts_lose_no_hit(spark):
    """Every pattern run bare over varied texts finds what the guarded one finds."""
    pieces = [
        "3 years of experience", "6-12 months exp", "contract for 2 years", "call 0912345678 90",
        "$5-10 per hour", "5k-7k USD", "12 million VND", "part time", "freelance", "in-person", "FT", "pt.",
        "MBA", "Ph.D", "aa degree", "ged", "Dec 2023", "urgent", "1-1-2024", "http://a.b", "ASSOCIATE'S degree",
    ]
    texts = [f"{a} é{b} {c}" for a in pieces for b in pieces[::3] for c in pieces[::5]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = df.withColumn("l", rules.lowered(F.col("t")))
    got = low.select("t", *[rules.extract(F.col("t"), k, F.col("l")).alias(k) for k in rules.RULES]).collect()
    for row in got:
        for kind, members in rules.RULES.items():
            flags = 0 if kind in rules.CASE_SENSITIVE else re.I
            hits = [h for r in members for h in re.findall(r.pattern, row.t, flags)]
            if kind in rules.IN_LOWER_CASE:
                hits = [h.lower() for h in hits]
            if kind == "phone_numbers":
                hits = [re.sub(r"\s+", "-", h.strip()) for h in hits]
            assert list(dict.fromkeys(hits)) == row[kind], (kind, row.t)


def test_kinds_can_be_left_out(spark):
    assert "emails" not in rules.extract_all(F.col("t"), F.col("l"), skip=("emails",))
    with pytest.raises(ValueError):
        rules.extract_all(F.col("t"), skip=("durations",))


def test_requirements(value):
    given = "Requirements:\n3+ years, master's degree, remote\nAbout: us\n"
    found = value(rules.requirements, given)
    assert found.raw_requirements == "3+ years, master's degree, remote"
    assert found.durations == ["3+ years"]
    assert found.education_levels == ["master's degree"]
    assert found.work_arrangements == ["remote"]
    assert value(rules.requirements, "nothing of the kind") is None


def test_signs_of_many_texts(spark):
    """Texts are searched together: hits end where a text ends, and letters beyond ASCII keep their places."""
    texts = ["5", "years", None, "10–15 TRIỆU ĐỒNG, ٣ years", "worK from home; maſter's", "é 1/2/", "2024", "a@b.com@c.org www.", "x.y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    kinds = list(rules.RULES)
    got = df.select("i", *[rules.extract(F.col("t"), k).alias(k) for k in kinds]).orderBy("i").collect()
    found = {(r.i, k): r[k] for r in got for k in kinds if r[k]}
    assert found == {
        (3, "durations"): ["٣ years"],
        (3, "salaries"): ["10–15 TRIỆU ĐỒNG"],
        (4, "work_arrangements"): ["work from home"],
        (4, "education_levels"): ["master's"],
        (7, "emails"): ["a@b.com"],
    }


def test_cleaned_text_is_made_once(spark):
    """Several kinds of hits read one cleaned text, and no pattern of the JVM is left."""
    df = spark.createDataFrame([("<p>call 555-123-4567 in Jan 2024, a@b.co</p>",)], "t string")
    found = df.select(*[c.alias(k) for k, c in rules.extract_all(clean(F.col("t"))).items()])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "regexp" not in plan
    row = found.first()
    assert (row.dates, row.phone_numbers, row.emails) == (["Jan 2024"], ["555-123-4567"], ["a@b.co"])

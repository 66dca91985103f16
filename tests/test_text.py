import html
import random

import pytest
from pyspark.sql import functions as F

from vacancylake.functions import text
from vacancylake.functions.entities import unescape


def test_demo_is_cleaned_to_one_line(value, demo):
    cleaned = value(text.clean, demo)
    assert cleaned.startswith("Senior Data Scientist - Machine Learning Engineer We are looking")
    assert "Responsibilities: • Develop and implement" in cleaned
    assert cleaned.endswith("Location: San Francisco, CA (Remote OK)")
    # Nothing but whitespace and indentation is to be cleaned in this text.
    assert cleaned == " ".join(demo.split())


@pytest.mark.parametrize(
    "given, wanted",
    [
        (None, ""),
        ("too short", ""),
        ("     1234567 \n", ""),
        ("exactly 10", "exactly 10"),
        ("<p>Tom &amp; Co</p><ul><li>one</li><li>two</li></ul>", "Tom & Co • one • • two •"),
        ("&lt;b&gt;bold&lt;/b&gt; and plain", "bold and plain"),
        ("Node.js developer wanted", "Node.js developer wanted"),
        ("1. first item\na) second item", "• first item • second item"),
        ("▪ square\n◦ round bullets", "• square • round bullets"),
        ("Space before , comma .Next sentence", "Space before, comma. Next sentence"),
        ("wide space and\ttabs\r\n here", "wide space and tabs here"),
        ("<script>a<b</script> text text", "a text text"),
    ],
)
def test_clean(value, given, wanted):
    assert value(text.clean, given) == wanted


def test_clean_again_changes_nothing(spark, demo):
    texts = [demo, "<p>1. one , two.Three</p> and more text", "•• bullets ▪ and words here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(text.clean(F.col("t")).alias("t"))
    twice = once.select(text.clean(F.col("t")).alias("u"), "t").collect()
    assert all(r.t == r.u for r in twice)


def test_references_decode_as_in_the_standard_library(spark):
    rnd = random.Random(7)
    named = ["&eacute;", "&euro;", "&notin;", "&NotEqualTilde;", "&amp;lt;", "&ampx", "&copy2", "&nbsp;", "&bogus;"]
    numeric = ["&#39;", "&#x1F600;", "&#0;", "&#128;", "&#x9f;", "&#xD800;", "&#99999999999;", "&#xffff;", "&#7;",
               "&#65", "&#x41g", "&#", "&#x", "&;", "&", "& ", "&#13;", "&#x0d;", "&#0000000000000065;"]
    pieces = named + numeric + ["text", " ", "<b>", "a&b", "ü"]
    texts = named + numeric + ["".join(rnd.choices(pieces, k=6)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", unescape(F.col("t")).alias("u")).collect():
        assert row.u == html.unescape(row.t), row.t


def test_special_characters_go_but_urls_stay(value):
    got = value(text.remove_special, "a~b § x@y.org https://e.org/~me?a=1|2 ^")
    assert got == "a b   x@y.org https://e.org/~me?a=1|2  "


def test_sections_need_line_breaks(value, demo):
    found = value(lambda t: text.sections(text.clean(t, normalize_whitespace=False)), demo)
    assert found.requirements.startswith("• Master's degree in Computer Science")
    assert found.requirements.endswith("Experience with Agile/Scrum methodologies")
    assert found.responsibilities.startswith("• Develop and implement")
    assert found.benefits.endswith("Professional development budget")
    assert found.about is None


def test_normalised_forms(value):
    assert value(text.normalize, "  Node.js / CI-CD\tx_y ") == "node js ci cd x y"
    assert value(text.match_form, "C++, C# & Node.js (TIẾNG Anh)") == "c++ c# node js tiếng anh"


def test_statistics_of_cleaning(value):
    stats = value(lambda t: text.cleaning_stats(t, F.substring(t, 1, 5)), "hello  big world")
    assert (stats.original_length, stats.cleaned_length) == (16, 5)
    assert (stats.original_words, stats.cleaned_words) == (3, 1)
    assert stats.reduction_ratio == pytest.approx(1 - 5 / 16)
    assert value(lambda t: text.cleaning_stats(t, t), "").reduction_ratio == 0


def test_length_limits(value):
    assert value(lambda t: text.longer_than(t, 10), " " * 20 + "x") is False
    assert value(lambda t: text.longer_than(t, 10), "a\n\n\n\n\n\n\n\nb") is True
    assert value(lambda t: text.longer_than(t, 10), None) is False


def test_tags_before_a_rest_without_any(spark):
    """What follows the last ``>`` is not searched for tags, however many signs of them it holds."""
    given = ["a <b>b</b> < c <p", "<br/>x<a<b>y< z", "no tag < at & all", "x</LI >y", ""]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = [r.v for r in rows.select("i", text.tags_to_layout(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == ["a  b  < c <p", "\nx y< z", "no tag < at & all", "x\n• y", ""]


def test_words_are_those_of_the_match_form(value):
    given = "  Node.js, C++/C# – kinh nghiệm_2 "
    assert value(text.match_words, given) == ["node", "js", "c++", "c#", "kinh", "nghiệm", "2"]
    assert value(text.match_form, given) == "node js c++ c# kinh nghiệm 2"
    assert value(text.match_form, " .- ") == "" and value(text.match_form, None) is None


ODD_SIGNS = [*" \t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u2028\u3000", *"•·▪‣1٣²ⓐaZé_-–.)!?:;,+#&<>/", "e\u0301", "İ", "Σ", "\u200d", "𝒜", "😀", "x. ", "\n", "\n•", "\n2. ",
             "&amp;", "&lt;", "&nbsp;", "&eacute;", "&#8226;", "<p>", "</P>", "<br />", "<BR\xa0/>", "<lı>", "<li class='a'>", "</ul>", "<div", "<pre\n>", ". A"]


def _odd_texts():
    rnd = random.Random(11)
    return ["".join(rnd.choices(ODD_SIGNS, k=rnd.randint(0, 40))) for _ in range(3000)]


def _single_steps(t):
    """``clean`` put together from the column functions of its steps."""
    marked = F.contains(t, F.lit("<")) | F.contains(t, F.lit("&"))
    result = F.when(marked, text.tags_to_layout(unescape(t))).otherwise(t)
    result = text.collapse_whitespace(text.numbered_bullets(text.symbol_bullets(result)))
    return F.when(text.longer_than(t, 10), text._tidy_line(F.trim(result))).otherwise(F.lit(""))


def test_a_text_is_cleaned_at_once_as_step_by_step(spark):
    df = spark.createDataFrame([(t,) for t in _odd_texts()], "t string")
    for row in df.select("t", text.clean(F.col("t")).alias("u"), _single_steps(F.col("t")).alias("v")).collect():
        assert row.u == row.v, row.t


def test_words_and_counts_of_odd_texts(spark):
    t = F.col("t")
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{M}\p{N}+#]+"), F.lit(0))
    stripped = text.strip(t)
    count = F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(stripped, rf"(?U)[{text.SPACE}]+")))
    df = spark.createDataFrame([(t,) for t in _odd_texts()], "t string")
    for row in df.select("t", text.match_words(t).alias("w"), words.alias("x"), text.word_count(t).alias("n"), count.alias("m")).collect():
        assert (row.w, row.n) == (row.x, row.m), row.t


def test_bytes_that_are_no_text_are_cleaned_with_replacements(spark):
    given = spark.sql("SELECT CAST(X'61626364FF2020656667686970' AS STRING) AS t")
    assert given.select(text.clean(F.col("t")).alias("c")).first().c == "abcd\ufffd efghip"


def test_cleaning_and_matching_take_plain_searches(spark):
    """No pattern is tried at every sign of a text in the steps that all queries on descriptions share."""
    from vacancylake.operators.term_match import TermIndex

    df = spark.createDataFrame([("a",)], "t string")
    for step in (text.clean(F.col("t")), text.match_form(F.col("t")), TermIndex([]).match(F.col("t"))):
        plan = df.select(step.alias("v"))._jdf.queryExecution().executedPlan().toString()
        assert "regexp_replace" not in plan and "regexp_extract_all" not in plan and "ArrowEvalPython" in plan


def test_texts_of_one_batch_do_not_touch_each_other(spark):
    """Signs that part texts inside a batch, bytes that are no text, and letters whose case depends on their place."""
    texts = ["\x00Java\x00\x00SQL", "", None, "ΟΔΟΣ ΣΑΣ", "İstanbul Kelvin K", " , x . Next", "É•é–Ⓐ", "A" * 300_000 + " B"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    forms = dict(df.select("i", text.match_form(F.col("t"))).collect())
    assert forms == {
        0: "java sql", 1: "", 2: None, 3: "οδος σας", 4: "i̇stanbul kelvin k", 5: "x next", 6: "é é", 7: "a" * 300_000 + " b"
    }
    cleaned = dict(df.select("i", text.clean(F.col("t"), min_length=2)).collect())
    assert (cleaned[0], cleaned[1], cleaned[2], cleaned[5]) == ("\x00Java\x00\x00SQL", "", "", ", x. Next")
    bad = spark.sql("select cast(X'4AC33A20FF41' as string) t")
    assert bad.select(text.word_count(F.col("t")), text.match_form(F.col("t"))).first() == (2, "j a")

import pytest
from pyspark.sql import functions as F

from vacancylake.functions import cards
from vacancylake.operators.html_cards import parse_cards, parse_descriptions, postings_from_pages
from vacancylake.schemas import POSTING


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Be an early applicant", 0),
        ("25 applicants", 25),
        ("12 người đã nộp", 12),
        ("7 people applied, 30 people clicked apply", 30),
        ("Applicants: 41", 41),
        ("3applicants", 3),
        ("no numbers", None),
        (None, None),
    ],
)
def test_applicants(value, given, wanted):
    assert value(cards.applicants, given) == wanted


def test_applicants_of_elements(spark):
    df = spark.createDataFrame([(["x", "9 applicants, 4 applicants", "early applicant"],)], "t array<string>")
    assert df.select(cards.applicants_of_elements(F.col("t")).alias("v")).first().v == 9


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Engineer\n 2 days ago \nHanoi", "2 days ago"),
        ("Engineer\n3 giờ trước", "3 giờ trước"),
        ("Hôm nay", "hôm nay"),
        ("Engineer", None),
    ],
)
def test_posted_at(value, given, wanted):
    assert value(cards.posted_at, given) == wanted


def test_search_url(spark):
    df = spark.createDataFrame(
        [("linkedin", "data", "ho-chi-minh"), ("topcv", "kỹ sư", None), ("itviec", "", ""), ("other", "a", "b")],
        "s string, k string, l string",
    )
    got = [r.u for r in df.select(cards.search_url(F.col("s"), F.col("k"), F.col("l")).alias("u")).collect()]
    assert got == [
        "https://www.linkedin.com/jobs/search/?keywords=data&location=ho-chi-minh",
        "https://www.topcv.vn/tim-viec-lam?keyword=k%E1%BB%B9+s%C6%B0",
        "https://itviec.com/it-jobs",
        None,
    ]


PAGES = [
    (1, "vietnamworks",
     '<div class="jobs-list"><div class="job-item x"><h3><a href="/a">One <b>bold</b></a></h3>'
     '<div class="company"><div>Nested &amp; Co</div></div><time datetime="2024-01-01">old</time></div>'
     '<div class="job-item"><p>no title</p></div></div>'),
    (2, "linkedin",
     '<ul class="jobs-search__results-list"><li><a href="/jobs/view/7">Two</a>'
     '<div class="job-search-card__location">Huế</div><span aria-label="5 applicants"></span></li>'
     '<li><a class="job-card-list__title" href="u">Three</a><script>x</script></li></ul>'),
    (3, "itviec", '<div id="jobs"><div class="job-info"><h3><a href="h">Four</a></h3><li class="city">Hà Nội</div></div>'),
    (4, "unknown", "<div class='job'><h3><a>x</a></h3></div>"),
    (5, "topcv", None),
    (6, "topcv", '<div class="box-job"><div class="title"><a href="t">Six</a></div><br><i class="salary">10 triệu</i>'),
]


def test_parse_cards(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, site string, html string")
    got = {(r.page_id, r.card_no): r for r in parse_cards(pages, "page_id", "site", "html").collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (3, 1), (6, 1)}
    first = got[1, 1]
    assert (first.title, first.company, first.url, first.posted_at) == ("One bold", "Nested & Co", "/a", "2024-01-01")
    assert first.card_html.startswith('<div class="job-item x">') and first.card_html.endswith("</div>")
    assert (got[2, 1].title, got[2, 1].location) == ("Two", "Huế")
    assert got[2, 1].element_texts == ["Huế", "5 applicants"]
    assert (got[2, 2].title, got[2, 2].url, got[2, 2].company) == ("Three", "u", None)
    assert got[2, 2].card_text == "Three"
    assert got[3, 1].location == "Hà Nội"
    assert (got[6, 1].title, got[6, 1].salary) == ("Six", "10 triệu")


def test_descriptions(spark):
    long = "a long enough fragment of the panel"
    pages = spark.createDataFrame(
        [
            (1, '<div class="description__text">B</div><div class="jobs-description__content">A</div>'
                '<div class="description__text">B</div>'),
            (2, f'<div class="scaffold-layout__detail"><h1 class="job-title-big">{long} title</h1><p>{long}</p>'
                f"<p>short</p><p>{long}</p></div>"),
            (3, None),
        ],
        "id long, html string",
    )
    parts = parse_descriptions(pages, "id", "html")
    got = parts.select(
        "id",
        F.coalesce(cards.join_fragments(F.col("parts")), cards.join_panel_fragments(F.col("fragments"))).alias("d"),
    )
    assert {r.id: r.d for r in got.collect()} == {1: "A\n\nB", 2: long, 3: None}


def test_postings(spark):
    card = '<div class="job-card"><div class="job-title"><a href="/{0}">T{0}</a></div><p>{1}</p>{2}</div>'
    page = '<div class="jobs-list">' + card.format(1, "Posted 3 days ago", "<span>25 applicants</span>") + (
        card.format(2, "now", '<!-- <b> --><span aria-label="be among the first" title="a > b">x</span>')
    ) + "</div>"
    details = '<div class="scaffold-layout__detail"><span class="nav">away with this long text</span><p>' + "what one does there " * 2 + "</p></div>"
    df = spark.createDataFrame([(1, "vietnamworks", page, details), (2, "vietnamworks", "<p>", None)], "k long, s string, h string, d string")
    got = {r.url: r for r in postings_from_pages(df, "k", "s", "h", "d").collect()}
    assert set(got) == {"/1", "/2"}
    assert [f.name for f in POSTING] == list(got["/1"].asDict())[2:]
    assert (got["/1"].title, got["/1"].applicants, got["/1"].posted_at) == ("T1", 25, "Posted 3 days ago")
    assert (got["/2"].applicants, got["/2"].posted_at, got["/2"].source) == (0, None, "vietnamworks")
    assert got["/2"].description == ("what one does there " * 2).strip()
    assert got["/1"].raw.card_html.startswith('<div class="job-card">') and got["/1"].raw.card_html.endswith("</div>")


def test_a_page_of_a_thousand_cards(spark):
    card = '<div class="job-item"><h3><a href="/{0}">T{0}</a></h3><div class="company"><a>C{0}</a></div><span aria-label="n{0}">s</span></div>'
    page = '<div class="jobs-list">' + "".join(card.format(i) for i in range(1000)) + "</div>"
    df = spark.createDataFrame([(1, "vietnamworks", page), (2, "vietnamworks", page)], "page_id long, site string, html string")
    got = parse_cards(df, "page_id", "site", "html").collect()
    assert len(got) == 2000
    assert all((r.title, r.company, r.url) == (f"T{r.card_no - 1}", f"C{r.card_no - 1}", f"/{r.card_no - 1}") for r in got)
    assert all(r.element_texts == [f"C{r.card_no - 1}", "s", f"n{r.card_no - 1}"] for r in got)


def test_cards_inside_cards(spark):
    page = '<div class="job-card"><p>x</p><div class="job-card"><h3><a href="i">inner</a></h3></div><span class="location">L</span></div><h3><a>outside</a></h3>'
    df = spark.createDataFrame([(1, "vietnamworks", page)], "page_id long, site string, html string")
    got = [(r.card_no, r.title, r.location) for r in parse_cards(df, "page_id", "site", "html").orderBy("card_no").collect()]
    assert got == [(1, "inner", "L"), (2, "inner", None)]


def test_repeated_pages_stay_apart(spark):
    pages = spark.createDataFrame([PAGES[0]] * 3 + [PAGES[2]], "page_id long, site string, html string")
    assert parse_cards(pages, "page_id", "site", "html").count() == 4

import random

import pytest
from pyspark.sql import functions as F

from vacancylake.operators.fuzzy import add_fuzzy, candidates, fuzzy_matches
from vacancylake.operators.term_match import (
    TermIndex,
    keyword_confidence,
    label_places,
    long_matches,
    match_by_join,
    plain_form,
    seniority,
    top_matches,
)
from vacancylake.plans.enrich import MATCH_FIELDS, enrich
from vacancylake.schemas import TERM
from vacancylake.sources.dictionaries import builtin_terms, collect_terms, read_dictionary, surface_forms, write_dictionary
from vacancylake.sources.postings import from_records
from vacancylake.sources.vocabulary import COMPACT_DICTIONARIES, DICTIONARIES, Term, flatten

FIELDS = ["keyword", "matched_text", "score", "match_type", "category", "weight", "subcategory"]


def brute_force(text, terms):
    """Best surface form per dictionary and term, by plain search."""
    padded, best = f" {plain_form(text)} ", {}
    for t in terms:
        if f" {plain_form(t.alias)} " in padded:
            old = best.get((t.dict, t.term))
            if old is None or t.alias_pos < old.alias_pos:
                best[t.dict, t.term] = t
    return {(d, k, t.alias, t.alias_pos == 0, t.category) for (d, k), t in best.items()}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = [w for t in flatten(DICTIONARIES) for w in t.alias.split()]
    noise = ["the", "với", "in/out", "C++,", "e.g.", "(node.js)", "_under_", "x2"]
    return [" ".join(rnd.choices(words + noise, k=rnd.randint(0, 60))) for _ in range(150)] + ["", None]


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def keyed(df):
    return {(r.id, r.dict, r.keyword, r.matched_text, r.match_type == "exact", r.category) for r in df.collect()}


def test_index_and_joins_agree_with_plain_search(spark, rows, texts):
    terms = flatten(DICTIONARIES)
    wanted = {(i, *m) for i, t in enumerate(texts) for m in brute_force(t or "", terms)}
    assert keyed(long_matches(rows, "id", "t", TermIndex(terms))) == wanted
    assert keyed(match_by_join(rows, "id", "t", builtin_terms(spark))) == wanted
    assert keyed(match_by_join(rows, "id", "t", builtin_terms(spark), whole_phrases=True)) == wanted


def test_one_text_may_hold_a_third_of_all_rows(spark):
    hot = spark.range(600).select("id", F.lit("python and machine learning on aws").alias("t"))
    got = match_by_join(hot, "id", "t", builtin_terms(spark), whole_phrases=True)
    assert got.where("dict = 'skills'").count() == 1200


def test_records_and_precedence(spark):
    df = spark.createDataFrame([("c++, c# and node.js; thực tập, k8s & kubernetes",)], "t string")
    m = df.select(TermIndex.builtin().match(F.col("t")).alias("m")).first().m
    skills = {r.keyword: r for r in m.skills}
    assert set(skills) == {"c++", "c#", "javascript"}
    assert (skills["c#"].match_type, skills["c#"].score) == ("exact", 1.0)
    assert (skills["javascript"].matched_text, skills["javascript"].score) == ("js", 0.9)
    assert [r.match_type for r in m.skills] == ["exact", "exact", "alias"]
    assert {r.keyword: r.match_type for r in m.technologies}["kubernetes"] == "exact"
    assert {(r.keyword, r.category) for r in m.vietnamese_keywords} == {
        ("fresher", "seniority_levels"), ("thực tập", "vietnamese_job_types")
    }
    assert [r.keyword for r in m.seniority_levels] == ["fresher"]


def test_confidence_and_top(spark):
    df = spark.createDataFrame([("python, sql, k8s",), ("nothing here",), ("tiếng anh",)], "t string")
    index = TermIndex.builtin()
    m = df.select("t", index.match(F.col("t")).alias("m"))
    lists = [F.col(f"m.{n}") for n in ("skills", "technologies", "soft_skills", "industry_terms")]
    total = sum((F.size(F.col(f"m.{n}")) for n in index.names), F.lit(0))
    scores = {r.t: r.c for r in m.select("t", keyword_confidence(lists, total).alias("c")).collect()}
    assert scores["nothing here"] == 0 and scores["tiếng anh"] == 0
    assert scores["python, sql, k8s"] == 1.0
    best = m.select(top_matches({"technologies": F.col("m.technologies"), "skills": F.col("m.skills")}, 2).alias("x")).first().x
    assert [(r.keyword, r.match_category) for r in best] == [("python", "skills"), ("sql", "skills")]


def test_seniority_by_group_name(spark):
    df = spark.range(1).select(F.expr("array(named_struct('category', 'level_a'), named_struct('category', 'b'))").alias("m"))
    assert df.select(F.size(seniority(F.col("m"))).alias("n")).first().n == 1


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(
        '{"tools": {"ant": {"category": "build", "weight": 2.0, "aliases": ["apache ant"]}, "bee": {}},'
        ' "cat": {"category": "flat", "weight": 0.5, "aliases": ["kitty"]}}', encoding="utf-8"
    )
    terms = collect_terms(read_dictionary(spark, str(path), "mine"))
    assert {(t.category, t.term, t.alias, t.alias_pos, t.weight, t.subcategory) for t in terms} == {
        ("tools", "ant", "ant", 0, 2.0, "build"), ("tools", "ant", "apache ant", 1, 2.0, "build"),
        ("tools", "bee", "bee", 0, 1.0, ""), ("mine", "cat", "cat", 0, 0.5, "flat"),
        ("mine", "cat", "kitty", 1, 0.5, "flat"),
    }
    df = spark.createDataFrame([(1, "Apache Ant and kitty")], "id long, t string")
    assert {r.keyword for r in long_matches(df, "id", "t", TermIndex(terms)).collect()} == {"ant", "cat"}


def test_compact_dictionaries(spark):
    df = spark.createDataFrame([("pandas and golang",)], "t string")
    m = df.select(TermIndex.builtin(COMPACT_DICTIONARIES).match(F.col("t")).alias("m")).first().m
    assert [r.keyword for r in m.skills] == ["go"]


def test_index_is_bounded():
    many = [Term("d", "g", "", f"t{i}", 1.0, f"t{i}", 0) for i in range(6000)]
    with pytest.raises(ValueError):
        TermIndex(many)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_agrees_with_every_pair(spark):
    terms = [t for t in flatten(DICTIONARIES) if t.dict in ("skills", "industry_terms")]
    texts = ["javascrpt and pythn", "machin learning enginer", "tensor flow; tenserflow", "product manger", "postgresq", "", "reactt, scalla; sq", "x" * 70 + " gow"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    wanted = {}
    for i, text in enumerate(texts):
        words = plain_form(text).split()
        for t in terms:
            form = plain_form(t.alias)
            if t.alias_pos:
                continue
            n = len(form.split())
            for at in range(len(words) - n + 1):
                phrase = " ".join(words[at : at + n])
                score = round(200 * common(phrase, form) / (len(phrase) + len(form))) / 100
                if score >= 0.8:
                    key = (i, t.dict, t.term)
                    wanted[key] = max(score, wanted.get(key, 0))
    got = fuzzy_matches(df, "id", "t", terms).collect()
    assert {(r.id, r.dict, r.keyword): r.score for r in got} == pytest.approx(wanted)
    assert wanted


@pytest.mark.parametrize("cutoff", [0.795, 0.7, 0.9, 0.6])
def test_index_of_letter_pairs_loses_no_pair(spark, cutoff):
    """Every phrase and form that reach the cutoff are candidates, and most others are not."""
    rnd = random.Random(11)

    def varied(word):
        letters = list(word)
        for _ in range(rnd.randint(0, len(word) // 3 + 1)):
            at = rnd.randrange(len(letters) + 1)
            letters[at : at + rnd.randint(0, 1)] = rnd.choices("abx ", k=rnd.randint(0, 1))
        return " ".join("".join(letters).split())

    forms = sorted({"".join(rnd.choices("abcdefgh", k=rnd.randint(1, 16))) for _ in range(60)} | {"aaaaaaaa", "abababab", "ab", "a"})
    words = sorted({v for f in forms for v in [varied(f) for _ in range(4)] if v and " " not in v} | {"aaaaaa", "axb", "abababa"})
    got = candidates(
        spark.createDataFrame([(1, w) for w in words], "words int, phrase string"),
        spark.createDataFrame([(1, f) for f in forms], "words int, form string"),
        cutoff,
    ).collect()
    pairs = {(r.phrase, r.form) for r in got}
    wanted = {(w, f) for w in words for f in forms if 2 * common(w, f) / (len(w) + len(f)) >= cutoff}
    assert wanted <= pairs
    assert len(wanted) > 50 and (cutoff < 0.75 or len(pairs) < len(words) * len(forms) / 4)


def test_aliases_of_hundreds_of_words(spark):
    """Long forms are found whole, and only whole."""
    long = " ".join(f"w{i % 7}" for i in range(500))
    rows = [("one", long), ("two", "w0 w1"), ("three", " ".join(f"v{i}" for i in range(120)))]
    terms = spark.createDataFrame([("d", "c", "", t, 1.0, a, 0) for t, a in rows], TERM)
    texts = [long, f"x {long} y", long[:-1] + "9", rows[2][1], rows[2][1] + "0", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.id, r.keyword) for r in match_by_join(df, "id", "t", terms, whole_phrases=True).collect()}
    assert got == {(0, "one"), (1, "one"), (0, "two"), (1, "two"), (2, "two"), (3, "three")}


def test_places_of_labels(spark):
    texts = ["Lead data scientist, Python and python; machine learning", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [(r.label, r.phrase, r["at"]) for r in label_places(df, "id", "t").orderBy("at", "label", "phrase").collect()]
    assert ("roles", "data scientist", 1) in got and ("skills", "machine learning", 6) in got
    assert [at for _, phrase, at in got if phrase == "python"] == [3, 5]
    matched = df.select(TermIndex.builtin().match(F.col("t")).alias("m")).first().m
    for label in ("skills", "roles"):
        first = dict.fromkeys(p for n, p, _ in got if n == label)
        assert list(first) == matched[f"label_{label}"]


def test_dictionary_lines(spark, tmp_path):
    rows = [(f"g{i % 3}", f"term {i}", '{"category": "c", "aliases": ["alias %d", "x"]}' % i) for i in range(500)]
    entries = spark.createDataFrame([*rows, ("g1", "bare", "{}")], "category string, term string, body string")
    path = str(tmp_path / "lines")
    write_dictionary(entries, path)
    assert spark.read.text(path).count() >= 5
    got = {tuple(r) for r in read_dictionary(spark, path, "mine", lines=True).collect()}
    assert got == {tuple(r) for r in surface_forms(entries, "mine").collect()}


def test_fuzzy_only_fills_gaps(spark):
    terms = flatten({"skills": DICTIONARIES["skills"]})
    df = spark.createDataFrame([(1, "javascript javascrpt and kotlinn")], "id long, t string")
    exact = long_matches(df, "id", "t", TermIndex(terms))
    both = add_fuzzy(exact, fuzzy_matches(df, "id", "t", terms), "id").collect()
    assert {(r.keyword, r.match_type) for r in both} == {("javascript", "exact"), ("kotlin", "fuzzy")}
    with pytest.raises(ValueError):
        fuzzy_matches(df, "id", "t", terms, scorer="other")


@pytest.mark.parametrize("fuzzy", [False, True])
def test_enrichment_with_a_dictionary_of_any_size(spark, fuzzy, monkeypatch):
    """The plan for small dictionaries and the one for large ones give equal matches."""
    terms = builtin_terms(spark)
    texts = [
        "Senior engineer with Python, javascript and machine learning, tiếng anh", "reactt and kubernets, deep lerning team lead " * 3,
        None, "", "short", "thực tập, bảo hiểm, fresher level with 5+ years of experience in C++ and Node.js",
    ]
    postings = from_records(spark, [{"job_id": i, "title": "t", "description": t} for i, t in enumerate(texts)])

    def shown():
        e = enrich(postings, terms=terms, fuzzy=fuzzy, min_length=2, keep_short=True)
        rows = e.select("job_id", "extracted.*", "processing.confidence_scores.*").collect()
        lists = [f for f in [*MATCH_FIELDS.values(), "seniority_levels"]]
        return {r.job_id: ({f: sorted(map(str, r[f] or [])) for f in lists}, r.total_matches, r.keyword_confidence) for r in rows}

    small = shown()
    monkeypatch.setattr(TermIndex, "holds", classmethod(lambda cls, terms: False))
    large = shown()
    assert small == large
    kinds = {m.split("match_type=")[1].split(",")[0] for row in small.values() for found in row[0].values() for m in found}
    assert ("'fuzzy'" in kinds) == fuzzy


@pytest.mark.parametrize(("fuzzy", "holds"), [(False, True), (False, False), (True, True), (True, False)])
def test_matches_of_postings_without_an_id_or_with_a_repeated_one(spark, fuzzy, holds, monkeypatch):
    monkeypatch.setattr(TermIndex, "holds", classmethod(lambda cls, terms: holds))
    texts = [
        "Senior engineer with Python and machine learning", "Postgresql, javascrpt and kubernets for a team lead",
        "Docker, reactt and deep lerning", "Java and Python for the backend", None, "",
    ]

    def shown(ids):
        postings = from_records(spark, [{"job_id": i, "title": "t", "description": t} for i, t in zip(ids, texts)])
        e = enrich(postings, terms=builtin_terms(spark), fuzzy=fuzzy, min_length=2, keep_short=True)
        lists = [f for f in [*MATCH_FIELDS.values(), "seniority_levels"]]
        rows = e.select("description", "extracted.*").collect()
        return sorted((str(r.description), [sorted(map(str, r[f] or [])) for f in lists]) for r in rows)

    want = shown(range(len(texts)))
    assert sum(any(found) for _, found in want) == 4
    assert shown([7, 7, None, None, 7, None]) == want


def test_user_dictionary_fields(spark):
    entries = spark.createDataFrame([("tools", "hammer", '{"aliases": ["mallet"]}')], "category string, term string, body string")
    df = from_records(spark, [{"job_id": 1, "title": "t", "description": "a mallet and a hamer " * 5}])
    e = enrich(df, terms=surface_forms(entries, "mine"), fuzzy=True).first()
    assert [(m.keyword, m.match_type) for m in e.extracted.matched_mine] == [("hammer", "alias")]
    assert e.extracted.matched_skills == [] and e.extraction_stats.total_matches == 0


def test_texts_are_searched_again_for_fuzzy_hits_alone(spark):
    """The runs of words that are like no term are not joined; texts without any hit have no rows."""
    df = spark.createDataFrame([(1, "Pythn, and machine lerning"), (2, "zzzz qqqq"), (3, None), (4, "")], "id int, t string")
    found = fuzzy_matches(df, "id", "t", flatten(DICTIONARIES))
    assert "array_join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.keyword) for r in found.collect()} >= {(1, "python"), (1, "machine learning")}
    assert fuzzy_matches(df.where("id > 1"), "id", "t", flatten(DICTIONARIES)).count() == 0


@pytest.mark.parametrize("cutoff", [0.795, 0.6])
def test_runs_of_words_with_a_partner_are_kept(spark, cutoff):
    """Every run that reaches the cutoff with a name of as many words is there once; most others are gone."""
    from vacancylake.operators.gram_index import PairGate
    from vacancylake.operators.phrases import distinct_phrases

    names = ["deep learning", "machine learning", "kỹ sư", "c++", "project management office", "go"]
    texts = ["maschine lerning and deep learnin", None, "", "ky sư kỹ sự c++ c+ go gol", "the projekt management ofice of all time", "deep", "learning"]
    forms = spark.createDataFrame([(len(n.split()), n) for n in names], "words int, form string")
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string").coalesce(1)
    got = [(r.words, r.phrase) for r in distinct_phrases(df, "t", PairGate(forms, "form", cutoff)).collect()]
    split = [t.split() for t in texts if t]
    every = {(n, " ".join(w[i : i + n])) for w in split for n in (1, 2, 3) for i in range(len(w) + 1 - n)}

    def indel(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
        return 2 * rows[-1][-1] / (len(a) + len(b))

    near = {(n, p) for n, p in every if any(indel(p, f) >= cutoff for f in names if len(f.split()) == n)}
    assert len(got) == len(set(got)) and near <= set(got) <= every
    assert (2, "deep learnin") in near and (len(got) < len(every) or cutoff < 2 / 3)

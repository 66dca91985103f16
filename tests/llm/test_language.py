import random
import zlib

from vacancylake.llm.language import identify

SCHEMA = "doc_id long, text string, lang string, score double, bucket int"
SYLLABLES = {
    "en": ["the", "tion", "ing", "ther", "and", "wh"],
    "de": ["sch", "ung", "ich", "keit", "ß", "ver"],
    "fr": ["eau", "eux", "tion", "ç", "ment", "que"],
}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_languages_are_found(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, lang, rng.randrange(4, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    # a wrong label on held-out rows must not matter
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i, t, lang in rows]
    truth = {i: next(k for k in SYLLABLES if lang == k) if lang != "xx" else None for i, _, lang in rows}
    odd = [(900, None, "en"), (901, "", "en"), (902, " 12 #!\n", "de"), (None, "theringtion and", "en"), (904, "whther " * 20000, None)]
    odd += [rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows + odd], SCHEMA).repartition(4)
    got = identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[904].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in (*SYLLABLES, "und") for r in got)
    seen = [(by_id[i].lang_pred, t) for i, t in truth.items() if t]
    assert sum(a == b for a, b in seen) > 0.97 * len(seen)
    guesses = [(by_id[i].lang_pred, text) for i, text, lang in rows if lang == "xx"]
    marks = {"en": "wh", "de": "sch", "fr": "eau"}
    clear = [(g, k) for g, text in guesses for k, m in marks.items() if m in text and sum(x in text for x in marks.values()) == 1]
    assert sum(g == k for g, k in clear) > 0.95 * len(clear) > 50


def test_nothing_to_learn_from(spark):
    assert identify(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "abc", None, 0.0, 0), (2, None, "en", 0.0, 0)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in identify(docs).collect()} == {("und", 0.0)}

import random
import re
from collections import Counter

import pyarrow as pa

from vacancylake.llm.quality import base_counts, base_failed, score, train

SCHEMA = "doc_id long, text string, quality int, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(covered)


def test_base_counts():
    rng = random.Random(2)
    parts = ["a", "bb", "é", "#x", "\n", "\n", " ", "\t", "a b c d e ", " ", "|", "\x0b", "\U0001f600", "same line\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(800)]
    texts += [None, "", "\n", "x", "x\nx", "x \nx", "x\n\nx\n", "a " * 9]
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        got = base_counts(pa.array(part, pa.large_string()))
        for n, text in enumerate(part):
            assert tuple(int(v[n]) for v in got.values()) == plain_counts(text), text
        assert base_failed(got).tolist() == [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in map(plain_counts, part)]


def test_verdicts(spark):
    rng = random.Random(9)
    syllables = ["the", "tion", "ing", "er", "an", "wh", "re", "st"]
    bad = ["moron", "scumbag"]

    def text(kind):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(40, 300))]
        if kind == "loud":
            return " ".join(w.upper() + "!!" for w in words)
        if kind == "toxic":
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    kinds = [rng.choice(["clean", "clean", "loud", "toxic"]) for _ in range(900)]
    docs = [(i, text(k)) for i, k in enumerate(kinds)] + [(1000, None), (1001, "a b"), (None, text("clean")), (0, text("clean"))]
    labels = [(i, int(k != "loud"), int(k == "toxic")) for i, k in enumerate(kinds) if i < 600] + [(5000, 1, 0), (3, None, 1)]
    frame = spark.createDataFrame([(*d, 3, None) for d in docs], SCHEMA).repartition(4)
    model = train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = score(frame, model).collect()
    assert len(got) == len(docs)
    right = Counter()
    for r in got:
        if r.doc_id is not None and 600 <= r.doc_id < 900:
            right[kinds[r.doc_id], r.kept] += 1
            assert 0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1
    assert right["clean", True] > 0.97 * (right["clean", True] + right["clean", False])
    assert right["loud", False] > 0.97 * (right["loud", True] + right["loud", False])
    assert right["toxic", False] > 0.9 * (right["toxic", True] + right["toxic", False])
    assert not any(r.kept for r in got if r.doc_id in (1000, 1001))


def test_without_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = train(empty, labels)
    assert score(empty, model).collect() == []
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 0, True)], SCHEMA)
    assert [r.kept for r in score(docs, model).collect()] == [True]

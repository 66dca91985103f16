import hashlib
import random
import re

import numpy as np
import pytest

from vacancylake.llm.substrings import FmIndex, deduplicate

SCHEMA = "doc_id long, text string, start int, d int, route string"


def plain(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(order, words):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for (doc, _), d, w in zip(rows, order, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def documents(rng, n):
    vocabulary = ["a", "bb", "é", "the", "x,", "of", "漢", "Z"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.randrange(20))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", " "]) for w in words)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (None, rows[5][1])]
    rows += [(n + 2, None), (n + 3, ""), (n + 4, " \n "), (n + 5, "ha " * 80), (n + 6, "ha " * 33), (4, rows[7][1])]
    return rows


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"hot_segments": 3, "shard_bytes": 200})])
def test_as_brute_force(spark, seed, limits):
    rows = documents(random.Random(seed), 120)
    docs = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], SCHEMA).repartition(4)
    got = deduplicate(docs, width=12, gram=4, **limits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == plain(rows, 12)
    assert sum(r.n_removed for r in got) > 100


def test_empty_table(spark):
    assert deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matches_are_those_of_the_text():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    text = np.concatenate([np.append(p, 0) for p in pieces])
    ends = np.flatnonzero(text == 0)
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = 5
    index = FmIndex(text, 4, width)
    other = rng.integers(1, 5, 400) % 4
    other = np.where(other == 0, 1, other)
    for query, begin, end in ((text, starts, ends), (other, np.array([0, 250]), np.array([250, 400]))):
        found = index.matches(query, begin, end)
        known = {tuple(text[i : i + width]) for i in range(len(text) - width + 1)}
        for b, e in zip(begin, end):
            for i in range(b, e):
                want = i + width <= e and tuple(query[i : i + width]) in known
                assert (found[i] >= 0) == want
                if want:
                    assert tuple(text[index.order[found[i]] :][:width]) == tuple(query[i : i + width])

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vacancylake.llm.ngram_join import linked, linked_documents, matched_prefix, one_of_each, shingles

SCHEMA = "doc_id long, text string, class int, label string, d int"


def sets_of(rows, n=5):
    out = []
    for _, t in rows:
        w = (t or "").split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute_force(rows):
    sets = sets_of(rows)
    links, near = [0] * len(rows), defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                near[i].add(j)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        label[i] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return sorted(((rows[i][0], label[i], links[i]) for i in range(len(rows))), key=str)


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdef", k=rng.randrange(1, 6)))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), rng.choice([" ", "\n "]).join(words)))
    hot = [word() for _ in range(80)]
    for _ in range(60):
        words = list(hot)
        words[rng.randrange(len(words))] = word()
        rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "a b"), (905, "a c"), (None, "a  b"), (None, None)]
    rows += [(0, rows[0][1]), (906, rows[50][1]), (906, rows[50][1]), (907, "x " * 30), (908, "x " * 60)]
    return rows


@pytest.mark.parametrize("seed, chunk", [(1, 128), (2, 7)])
def test_as_brute_force(spark, seed, chunk):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA).repartition(4)
    got = linked_documents(docs, chunk_classes=chunk).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute_force(rows)
    kept = one_of_each(docs, chunk_classes=chunk)
    assert kept.columns == docs.columns
    wanted = {(c if c is not None else d) for d, c, _ in brute_force(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == wanted


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert linked_documents(none).collect() == [] and one_of_each(none).collect() == []


def test_prefix_is_as_long_as_recall_allows():
    k = matched_prefix(24, 8, 0.8, 0.9999)
    assert 1 - (1 - 0.8**k) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (k + 1)) ** 24


def test_shingles_and_similarity():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(12)))) for i in range(200)]
    values, bounds = shingles(pa.array([t for _, t in rows], pa.large_string()), 5)
    plain = sets_of(rows)
    assert np.diff(bounds).tolist() == [len(s) for s in plain]
    sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    some = [k for k in range(200) if plain[k]]
    found = linked([sets[k] for k in some[:50]], [sets[k] for k in some[50:]], 0.5)
    for x, a in enumerate(some[:50]):
        for y, b in enumerate(some[50:]):
            assert found[x, y] == (2 * len(plain[a] & plain[b]) >= len(plain[a] | plain[b]))

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from vacancylake.llm.language_model import score

SCHEMA = "doc_id long, text string, word long, chunk int, n int"


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), "<end>"]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter(w for d, t in rows if not held(d) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = words_of(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((str(d), held(d), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    return sorted(out)


def corpus(rng):
    chains = {w: rng.sample(["one", "Two", "three,", "FOUR", "five", "six.", "é"], 2) for w in ["", "one", "Two", "three,", "FOUR", "five", "six.", "é"]}
    rows = []
    for i in range(500):
        words, last = [], ""
        for _ in range(rng.randrange(60)):
            last = rng.choice(chains[last]) if rng.random() < 0.9 else last
            words.append(last if rng.random() < 0.95 else f"rare{rng.randrange(400)}")
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows + [(900, None), (901, ""), (901, ""), (None, "one Two"), (3, rows[3][1]), (902, "one " * 30000), (903, "\x00 \x1f")]


def test_base_score_and_gain_on_held_out_rows(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got = score(docs).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    want = plain_base(rows)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert np.allclose([h[5] for h in have], [w[5] for w in want], rtol=1e-9, atol=2e-6)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.75 * sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)


def test_empty_table_and_nothing_learned(spark):
    assert score(spark.createDataFrame([], SCHEMA)).collect() == []
    doc = next(i for i in range(100) if held(i))
    got = score(spark.createDataFrame([(doc, "a b", 1, 2, 3)], SCHEMA)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)]

import hashlib
import random

import numpy as np
import pytest

from vacancylake.llm.suffixes import byte_index, deduplicate, eight_bytes, suffix_array

SCHEMA = "doc_id long, text string, start int, d int, route string"


def plain(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    order = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for d, t in zip(order, texts):
        for i in range(len(t) - width + 1):
            k = t[i : i + width]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (doc, _), d, t in zip(rows, order, texts):
        gone = set()
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < (d, i):
                gone.update(range(i, i + width))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(t)))
        kept = bytes(x for i, x in enumerate(t) if i not in gone)
        out.append((doc, len(t), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents(rng, n):
    signs = "abc é漢\n\x00"
    passages = ["".join(rng.choices(signs, k=rng.randrange(10, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(5)):
            text += rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices(signs, k=rng.randrange(40)))
        rows.append((i, text))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (None, rows[5][1])]
    rows += [(n + 2, None), (n + 3, ""), (n + 5, "ha " * 80), (n + 6, "a" * 99), (n + 7, "a" * 30), (4, rows[7][1])]
    return rows


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"hot_segments": 3, "shard_bytes": 150})])
def test_as_brute_force(spark, seed, limits):
    rows = documents(random.Random(seed), 120)
    docs = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], SCHEMA).repartition(4)
    got = deduplicate(docs, width=21, gram=7, **limits).collect()
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)
    assert have == plain(rows, 21)
    assert sum(r.n_removed for r in got) > 100


def test_empty_table(spark):
    assert deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffixes_are_sorted():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    data[200:400] = data[:200]
    order, _ = suffix_array(data, eight_bytes(data), 250)
    text = data.tobytes()
    assert [text[i : i + 250] for i in order] == sorted(text[i : i + 250] for i in range(len(text)))


@pytest.mark.parametrize("shard_bytes", [40, 1 << 20])
def test_windows_across_shards(shard_bytes):
    rng = random.Random(1)
    base = "".join(rng.choices("ab", k=60))
    segments = [base[i : i + 30].encode() for i in rng.sample(range(30), 12)]
    first_d = np.array([rng.randrange(50) for _ in segments])
    first_start = np.array([rng.randrange(5) for _ in segments])
    if shard_bytes == 40:  # an anchor lies in two shards at most
        segments, first_d, first_start = segments[:2], first_d[:2], first_start[:2]
    routes = np.zeros(len(segments), dtype=np.int64)
    d, s, counts = byte_index(20, shard_bytes)(segments, routes, first_d, first_start)
    best = {}
    for seg, doc, start in zip(segments, first_d, first_start):
        for w in range(len(seg) - 19):
            k = seg[w : w + 20]
            best[k] = min(best.get(k, (10**9, 0)), (doc, start + w))
    want = [best[seg[w : w + 20]] for seg in segments for w in range(len(seg) - 19)]
    assert list(zip(d, s)) == want and counts.sum() == len(want)


def test_segments_that_differ_beyond_the_depth_of_sorting():
    rng = random.Random(5)
    segments = set()
    for _ in range(6):
        base = rng.choices("abcdefgh", k=176)
        for _ in range(8):
            copy = list(base)
            for at in rng.sample([*range(40), *range(125, 176)], 2):
                copy[at] = rng.choice("abcdefgh")
            start = rng.randrange(40)
            segments.add("".join(copy)[start : start + rng.randrange(100, 177)].encode())
    segments = sorted(segments)
    first_d = np.array([rng.randrange(50) for _ in segments])
    first_start = np.array([rng.randrange(500) for _ in segments])
    routes = np.zeros(len(segments), dtype=np.int64)
    d, s, _ = byte_index(100, 1 << 20)(segments, routes, first_d, first_start)
    windows = [(seg[w : w + 100], (doc, start + w)) for seg, doc, start in zip(segments, first_d, first_start) for w in range(len(seg) - 99)]
    best = {}
    for k, place in windows:
        best[k] = min(best.get(k, place), place)
    assert list(zip(d, s)) == [best[k] for k, _ in windows]

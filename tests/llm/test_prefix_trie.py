import hashlib
import random
import zlib

import pytest

from vacancylake.llm.prefix_trie import _medians, _Tree, trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, seq long, ids string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        sequence = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(sequence) + 1):
            nodes.setdefault(sequence[:d], []).append(c)
        ends.setdefault(sequence, []).append(c)
    total = {p: [0, 0] for p in nodes}
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        own_saving = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            total[p[:d]][0] += not children[p]
            total[p[:d]][1] += own_saving
    out = []
    for p, members in nodes.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], *total[p], digest))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie(df, **options).select(*COLUMNS).collect()), key=str)


def conversations(count, seed, kinds=4, longest=12):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"]) if t else "user", "hi" if t == 0 and rng.random() < 0.5 else f"é{rng.randrange(kinds)}")
        for c in rng.sample(range(1, 5 * count), count)
        for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("shard", [20_000, 7, 1])
def test_as_brute_force(spark, shard):
    rows = conversations(120, 3)
    assert found(spark, rows, shard=shard) == brute(rows)


def test_equal_conversations_and_prefixes(spark):
    """One conversation that half of all repeat, and one that is the start of others."""
    rows = []
    for c in range(5, 600, 5):
        rows += [(c, t, "user", f"t{t}") for t in range(4 if c % 2 else 1 + c % 7)]
    assert found(spark, rows, shard=2) == brute(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (2, 5, "user", "a" * 300_000), (2, 6, "user", "b"), (2, 6, "user", "b")]
    rows += [(None, 1, "user", "nobody's"), (7, 1, "us", "er"), (8, 1, "u", "ser"), (9, 1, "", ""), (14, None, None, None)]
    rows += [(c, t, "", "") for c in range(20, 40) for t in range(3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, shard=1) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_medians_keep_the_tree_flat():
    assert sorted(_medians(100)) == list(range(100))
    tree = _Tree()
    for i in _medians(1000):
        tree.insert([i], [1], i)
    deepest, stack = 0, [(tree.same[0], 1)]
    while stack:
        node, depth = stack.pop()
        if node >= 0:
            deepest = max(deepest, depth)
            stack += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest == 10

import hashlib
import zlib

import pytest

from vacancylake.llm.merkle import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, own long, path string"


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return H(*[part(v) for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def brute(rows):
    """Expected rows, level by level; ``rows``: doc_id, source, lang, n_chars, text."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {v: levels_of([m[2] for m in sorted(trees[v], key=lambda m: m[:3])]) for v in langs}
    upper = levels_of([built[v][-1][0] for v in langs])
    out = []
    for g, v in enumerate(langs):
        for at, (known, doc_id, leaf, row) in enumerate(sorted(trees[v], key=lambda m: m[:3])):
            changed = list(row)
            if known and zlib.crc32(str(doc_id).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            node, siblings = leaf_of(*changed), []
            for levels, place in ((built[v], at), (upper, g)):
                for level in levels[:-1]:
                    if place ^ 1 < len(level):
                        beside = level[place ^ 1]
                        siblings.append(beside)
                        node = H(beside, node) if place % 2 else H(node, beside)
                    else:
                        node = H(node)
                    place //= 2
            root = upper[-1][0]
            out.append((row[0], leaf, built[v][-1][0], root, H(*siblings), node, node == root))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(d, t, g, s, n, "x", 1, 2, "y") for d, s, g, n, t in rows], SCHEMA)
    return [tuple(r) for r in manifest(df).collect()]


def rows_of(counts):
    out, n = [], 0
    for lang, count in counts.items():
        for _ in range(count):
            n += 1
            out.append((n * 37 % 10_007, f"s{n % 3}", lang, n, f"texté {n}"))
    return out


@pytest.mark.parametrize(
    "counts",
    [{"en": 1}, {"en": 2, "de": 1}, {"en": 33, "de": 32, None: 31, "é": 1, "z": 5}, {"en": 1100, "fr": 64, "vi": 65}],
    ids=["one", "three", "odd", "three_bands"],
)
def test_as_brute_force(spark, counts):
    rows = rows_of(counts)
    got = found(spark, rows)
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert len(rows) < 3 or {r[-1] for r in got} == {True, False} or len(rows) < 20


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 3, "x"), (7, "s", "en", None, "a" * 300_000), (7, "s", "en", 1, ""), (7, "s", "en", 1, "")]
    rows += [(14, "s", "en", None, "n_chars is null"), (3, None, "en", 4, None)] + [(5, "s", "en", 2, "hot")] * 40
    assert sorted(found(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_many_languages(spark):
    rows = [(i, "s", f"l{i % 70}", i, "t") for i in range(150)]
    assert sorted(found(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    assert found(spark, []) == []

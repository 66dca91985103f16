import hashlib
import random
import re

import pytest

from vacancylake.llm import block_names, naming
from vacancylake.llm.block_names import deduplicate

SCHEMA = "doc_id long, text string, name string, row long, n long"


def brute(rows):
    groups = {}
    for at, (doc_id, text) in enumerate(rows):
        plain = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), doc_id is None, doc_id or 0, at, doc_id))
    out = []
    for plain, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[4], best[4], len(members), m is best, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], SCHEMA).coalesce(1)
    return sorted((tuple(r) for r in deduplicate(df, **options).collect()), key=str)


def texts():
    rng = random.Random(5)
    out = []
    for i in range(60):
        words = ["".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 40))]
        out.append((i, " ".join(words)))
        if i % 3 == 0:
            out.append((100 + i, rng.choice(["\n", "\t ", " \x0b"]).join(words) + " " * rng.randint(0, 2)))
    long = "".join(rng.choice("xyz ") for _ in range(20_000))
    out += [(200, long), (201, long + " "), (202, long + "x"), (203, long[:-1] + "!"), (204, long[1:])]
    return out + [(300, None), (301, ""), (302, " \n"), (303, " "), (None, "same"), (304, "sa me"), (304, "sa me"), (None, None)]


@pytest.mark.parametrize("size", [4096, 5, 1])
def test_as_brute_force(spark, size):
    rows = texts() if size > 1 else texts()[:40]
    assert rows_of(spark, rows, size=size) == brute(rows)


def test_fingerprints_may_meet(spark, monkeypatch):
    """Different blocks of one fingerprint still get names of their own."""
    from pyspark.sql import functions as F

    for module in (naming, block_names):
        monkeypatch.setattr(module, "fingerprint", lambda v: F.pmod(F.xxhash64(v), F.lit(3)))
    rows = texts()[:60]
    assert rows_of(spark, rows, size=6) == brute(rows)


def test_a_third_of_all_rows_may_be_equal(spark):
    rows = [(i, "one text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    assert rows_of(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert rows_of(spark, []) == []

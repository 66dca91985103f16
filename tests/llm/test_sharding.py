import zlib
from collections import Counter, defaultdict

from vacancylake.llm.sharding import shard

SCHEMA = "doc_id long, text string, label int, row int, hub string"


def laid_out(got, shards, n):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_rows_are_even_and_copies_together(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    rows += [(1000 + i, f"copied {i % 30}") for i in range(120)]
    rows += [(2000 + i, "hot é") for i in range(200)]
    rows += [(None, None), (None, None), (7, "text 7"), (8, ""), (9, "")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    got = shard(docs, shards=10, large_hub=16).collect()
    laid_out(got, 10, len(rows))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    texts = dict(rows)
    homes = defaultdict(set)
    for r in got:
        if r.doc_id is not None and 1000 <= r.doc_id < 2000:
            homes[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) == 1 for s in homes.values()) >= 20
    hot = Counter(r.shard for r in got if r.doc_id is not None and r.doc_id >= 2000)
    assert sum(n for _, n in hot.most_common(4)) >= 120, hot  # a shard has 62 or 63 seats
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_links_between_different_texts(spark):
    docs = spark.createDataFrame([(i, f"t{i}", 0, 0, "") for i in range(200)], SCHEMA)
    links = spark.createDataFrame([(i, f"hub {i // 10}") for i in range(200)], "doc_id long, hub string")
    got = shard(docs, shards=8, links=links, rounds=10).collect()
    laid_out(got, 8, 200)
    homes = defaultdict(Counter)
    for r in got:
        homes[r.doc_id // 10][r.shard] += 1
    kept = sum(sum(n * (n - 1) for n in c.values()) for c in homes.values())
    assert kept > 0.3 * 20 * 90, kept  # by chance it were an eighth


def test_small_tables(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []
    got = shard(spark.createDataFrame([(1, "a", 0, 0, "")], SCHEMA)).collect()
    assert [(r.slot, r["size"]) for r in got] == [(0, 17)]

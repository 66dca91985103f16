"""Balanced label propagation: linked documents share a shard, shards hold equally many rows (operator 2).

DataFrame functions only.  Documents are linked through hubs, a hub being whatever they have in
common; equal texts by default.  Labels start as a hash.  In each round every document counts its
neighbours' shards, by way of one tally per hub and shard, so a hub that a third of all documents
share costs ``shards`` rows and no pairs.  It moves to the shard where most of its neighbours are
while that shard has room: where more want in than fit, a hash decides who does.  Odd rounds move
to higher shards only and even rounds to lower ones, so that two neighbours don't swap for ever.

Rounds may overfill a shard by ``slack``, so that full shards can still trade.  Rows without links
have no label: they fill the seats that are left.  So do the rows that a round
let in beyond the seats of their shard, which makes the row counts exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylake.llm.tables import stored

ENTRY_BYTES = 16
#: Buckets of a ranking; their sums are the only rows that one task sees together.
BUCKETS = 4096


def _share(*columns: str | Column) -> Column:
    """A number from 0 to 1 that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _links(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    """``(row, hub)`` of all hubs with at least two rows."""
    links = rows.where("hub is not null").select("row", "hub")
    if more is not None:
        other = more.select(
            F.col("doc_id").alias("linked"), F.xxhash64(F.lit("link"), F.col("hub").cast("string")).alias("hub")
        )
        links = links.unionByName(
            rows.select("row", "doc_id").join(other, F.col("doc_id") == F.col("linked")).select("row", "hub")
        )
    links = links.distinct()
    shared = links.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1")
    return links.join(shared, "hub")


def _round(labels: DataFrame, links: DataFrame, step: int, shards: int, quota: float) -> DataFrame:
    """Labels after one round of moves."""
    rows = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    room = [quota - rows.get(j, 0) for j in range(shards)]
    at = links.join(labels, "row")
    votes = (
        at.groupBy("hub", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("hub")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("votes"))  # one for each shard at most
    )
    asked = at.join(votes, "hub").groupBy("row", "label").agg(F.collect_list("votes").alias("ballots"))

    def total(shard: Column) -> Column:
        return F.aggregate(
            "ballots", F.lit(0).cast("long"), lambda n, ballot: n + F.coalesce(F.try_element_at(ballot, shard), F.lit(0))
        )

    upwards = bool(step % 2)
    targets = F.array(*[F.lit(j) for j in range(shards) if room[j] > 0] or [F.lit(None).cast("int")])
    allowed = F.filter(targets, lambda j: (j > F.col("label")) if upwards else (j < F.col("label")))
    best = F.array_max(F.transform(allowed, lambda j: F.struct(total(j).alias("n"), (-j).alias("minus"))))
    wishes = stored(
        asked.select("row", "label", best.alias("best"), total(F.col("label")).alias("here"))
        .where("best.n >= here and best.n > 0")  # the row itself is one of those here
        .select("row", "label", (-F.col("best.minus")).alias("to")),
        "wishes",
    )
    flows = wishes.groupBy("label", "to").agg(F.count("*").alias("n")).collect()  # a row per pair of shards
    for flow in flows:
        room[flow["label"]] += flow["n"] / 2
    part = [min(1.0, max(0.0, room[j]) / max(1, sum(f["n"] for f in flows if f["to"] == j))) for j in range(shards)]
    admitted = _share("row", F.lit(step)) < F.array(*map(F.lit, part))[F.col("to")]
    return labels.join(wishes.where(admitted).select("row", "to"), "row", "left").select(
        "row", F.coalesce("to", "label").alias("label")
    )


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (label, bucket, hub, row, ...) with ``nth``, counted from 0 within each label."""
    sums = rows.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("label").alias("of_label"),
        F.col("bucket").alias("of_bucket"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    own = Window.partitionBy("label", "bucket").orderBy("hub", "row")
    return (
        rows.withColumn("in_bucket", F.row_number().over(own) - 1)
        .join(starts, (F.col("label") == F.col("of_label")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("nth", F.col("start") + F.col("in_bucket"))
        .drop("of_label", "of_bucket", "start", "in_bucket", "bucket")
    )


def _bucket(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def shard(
    docs: DataFrame,
    shards: int = 40,
    links: DataFrame | None = None,
    rounds: int = 6,
    slack: float = 0.1,
    large_hub: int = 1000,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``rows``: shards hold equally many rows, give or take one, and ``slot`` counts the
    rows of each from 0.  Documents of equal text are linked, and those that share a ``hub`` of
    ``links`` (``doc_id, hub``).  The driver sees one count per pair of shards.

    A null text has no bytes and no equal texts; empty texts equal each other.  Null and repeated
    ``doc_id`` are rows like others.  A vote that is tied goes to the lowest shard.  With fewer
    rows than shards some stay empty; an empty table gives no rows.  Other columns are not read.
    """
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ENTRY_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hub"),
        ),
        "rows",
    )
    total = rows.count()
    sizes = [(j + 1) * total // shards - j * total // shards for j in range(shards)]
    linked = stored(_links(rows, links), "links")
    labels = stored(
        linked.select("row").distinct().select("row", _bucket("row", shards).cast("int").alias("label")), "labels"
    )
    for step in range(rounds):
        labels = stored(_round(labels, linked.select("row", "hub"), step, shards, total / shards * (1 + slack)), "labels")
    # the largest hub of a row says which rows keep their seats together
    main = linked.groupBy("row").agg(F.max(F.struct("members", "hub")).alias("main"))
    spread = F.when(F.col("main.members") > large_hub, F.col("row")).otherwise(F.col("main.hub"))
    sitting = _ranked(
        labels.join(main, "row").select(
            "row", "label", F.col("main.hub").alias("hub"), _bucket(spread, BUCKETS // shards + 1).alias("bucket")
        ),
    )
    size = F.array(*map(F.lit, sizes))[F.col("label")]
    seated = stored(
        sitting.where(F.col("nth") < size).select("row", F.col("label").alias("shard"), F.col("nth").alias("slot")), "seated"
    )
    taken = {r["shard"]: r["n"] for r in seated.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    floating = _ranked(
        rows.select("row", F.lit(0).alias("label"), F.lit(0).alias("hub"), _bucket("row", BUCKETS).alias("bucket")).join(
            seated.select("row"), "row", "left_anti"
        ),
    )
    ends, end = [], 0
    for j in range(shards):
        end += sizes[j] - taken.get(j, 0)
        ends.append(end)
    firsts = [taken.get(j, 0) - (ends[j - 1] if j else 0) for j in range(shards)]
    passed = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("nth")))
    filled = floating.select("row", passed.alias("shard"), "nth").select(
        "row", "shard", (F.col("nth") + F.array(*map(F.lit, firsts))[F.col("shard")]).alias("slot")
    )
    return rows.join(seated.unionByName(filled), "row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

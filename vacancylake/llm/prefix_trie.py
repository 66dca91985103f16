"""Trie of conversation prefixes with members, leaves and savings per node (operator 12).

Turns become integers by way of a sorted dictionary, conversations sequences of integers, and equal
sequences one row.  The different sequences are dealt by range into shards of bounded size, so a
shard is an interval of the sorted sequences and only nodes on the way to its first and last
sequence can also occur elsewhere.  Each shard builds a ternary search tree over the turn ids,
inserting the median of its sequences first, then the medians of both halves, and so on, which keeps
the tree balanced.  An iterative walk from the deepest nodes up then adds up members, leaves and
savings.  Every shard knows the sequence before its first and the one after its last: that tells it
which nodes it shares, and which of those were already counted.  What it adds to shared nodes are
plain sums, merged by one aggregate over a few rows per shard, as deep as neighbours agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.naming import ambiguous, fingerprint, sorted_names, told_apart, with_names
from vacancylake.llm.tables import dropped, stored

#: Different sequences of a shard, about.
SHARD = 20_000
#: Conversation ids in a row of ends are of one range of so many.
ENDS = 256
#: Most turns that one conversation takes from another, and how many conversations share their source.
TAKEN, GROUP = 9, 5

NODE = (
    "key binary, parent_key binary, seq long, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def turn_ids(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, id, bytes``: one id per different role and text; written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    value = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"), value.alias("value")
    )
    rows = rows.withColumn("print", fingerprint("value"))
    doubtful = stored(ambiguous(rows.select("print", "value")), "doubtful")
    places = stored(told_apart(rows, doubtful), "turns")
    names = sorted_names(places, ["print", "value"], "id", "turn-names")
    out = stored(with_names(places, names, ["print", "value"]), "turn-ids")
    dropped(doubtful, places, names)
    return out


def own_sequences(ids: DataFrame) -> DataFrame:
    """``conv_id, ids, bytes``: the turns of each conversation in order, as two arrays."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "bytes")
    rows = ids.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("t"))
    return rows.select("conv_id", F.col("t.id").alias("ids"), F.col("t.bytes").alias("bytes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """The conversations with their first turns taken from the first one of their group."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    mine = own.select("conv_id", "ids", "bytes", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("_from"))
    source = own.select(
        F.col("conv_id").alias("_of"), *[F.slice(c, 1, TAKEN).alias(f"_{c}") for c in ("ids", "bytes")]
    )

    def joined(column: str) -> Column:
        first = F.coalesce(F.slice(f"_{column}", F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
        return F.concat(first, F.slice(column, F.col("h") + 1, F.size(column))).alias(column)

    return mine.join(source, F.col("_from") == F.col("_of"), "left").select("conv_id", joined("ids"), joined("bytes"))


def _common(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _medians(count: int) -> Iterator[int]:
    """0 to ``count - 1``, the middle first, then the middles of both halves, and so on."""
    spans, at = [(0, count)], 0
    while at < len(spans):
        low, high = spans[at]
        at += 1
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(low, middle), (middle + 1, high)]


class _Tree:
    """A ternary search tree of one shard; node 0 is the root without a turn."""

    def __init__(self) -> None:
        self.turn, self.low, self.same, self.high = [None], [-1], [-1], [-1]
        self.parent, self.depth, self.bytes, self.seq = [-1], [0], [0], [None]

    def _new(self, turn: int, parent: int, size: int) -> int:
        for column, value in (
            (self.turn, turn), (self.low, -1), (self.same, -1), (self.high, -1), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.bytes, size), (self.seq, None),
        ):
            column.append(value)
        return len(self.turn) - 1

    def child(self, parent: int, turn: int, size: int) -> int:
        """The node of ``turn`` below ``parent``, made if there is none; ``same`` leads to a node's children."""
        branch, at = self.same, parent
        node = branch[at]
        while node >= 0:
            if turn == self.turn[node]:
                return node
            branch, at = (self.low if turn < self.turn[node] else self.high), node
            node = branch[at]
        branch[at] = node = self._new(turn, parent, size)
        return node

    def insert(self, ids, sizes, seq: int) -> int:
        node = 0
        for turn, size in zip(ids, sizes):
            node = self.child(node, turn, size)
        self.seq[node] = seq
        return node


def _grown(shard: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard: rows with a key are shared and hold this shard's part, others are whole."""
    shard = shard.sort_values("seq")
    own = shard[shard["kind"] == 0]
    ids = [list(map(int, x)) for x in own["ids"]]
    sizes = [list(map(int, x)) for x in own["bytes"]]
    seqs, counts, firsts = (own[c].astype("int64").tolist() for c in ("seq", "n", "first"))
    edge = {k: [list(map(int, x)) for x in shard.loc[shard["kind"] == k, "ids"]] for k in (-1, 1)}
    before = _common(edge[-1][0], ids[0]) if edge[-1] else -1
    after = _common(ids[-1], edge[1][0]) if edge[1] else -1

    tree = _Tree()
    ends = [0] * len(ids)
    for at in _medians(len(ids)):
        ends[at] = tree.insert(ids[at], sizes[at], seqs[at])
    size = len(tree.turn)

    # Depths down to which the ways to the first and the last sequence are shared; the root always is.
    keys: dict[int, bytes] = {0: hashlib.sha256(b"").digest()}
    counted = {0} if before >= 0 else set()  # shared with the shard before, which counts them
    for sequence, depth in ((ids[0], before), (ids[-1], after)):
        node = 0
        for turn in sequence[: max(depth, 0)]:
            parent, node = node, tree.child(node, turn, 0)
            keys[node] = hashlib.sha256(keys[parent] + turn.to_bytes(8, "little", signed=True)).digest()
            if sequence is ids[0] and depth == before:
                counted.add(node)
    goes_on = ends[-1] if edge[1] and after == len(ids[-1]) else None  # its children are in the next shard

    n, first = [0] * size, [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at, end in enumerate(ends):
        n[end], first[end] = n[end] + counts[at], firsts[at]
    for node in range(size - 1, -1, -1):  # children were made after their parents
        if not children[node] and tree.same[node] < 0 and node != goes_on:
            leaves[node] += 1
        saved[node] += (n[node] - (node not in counted)) * tree.bytes[node]
        above = tree.parent[node]
        if above >= 0:
            n[above] += n[node]
            first[above] = first[node] if first[above] is None else min(first[above], first[node])
            children[above] += node not in counted
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    rows = []
    for node in range(size):
        above = tree.parent[node]
        shared_above = keys.get(above)
        rows.append((
            keys.get(node), shared_above, tree.seq[node], tree.depth[node], first[node],
            first[above] if above >= 0 and shared_above is None else None, n[node], children[node], leaves[node], saved[node],
        ))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])
    return out.astype({c: "Int64" for c in ("seq", "parent_conv_id")})


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seq, ends_sha256`` of rows ``seq, part, ends`` in that order; one row is looked at at a time."""
    seq, state = None, None
    for batch in batches:
        seqs, hashes = [], []
        for now, text in zip(batch.column("seq").to_pylist(), batch.column("ends")):
            if now == seq:
                state.update(b",")
            else:
                if seq is not None:
                    seqs.append(seq)
                    hashes.append(state.hexdigest())
                seq, state = now, hashlib.sha256()
            state.update(text.as_buffer())
        if seqs:
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(hashes, pa.string())], ["seq", "ends_sha256"])
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["seq", "ends_sha256"])


def trie(turns: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, as the operator's contract names them.

    A null role or text is empty; a null turn comes first, turns that tie come in the order of their
    dictionary ids, and repeated rows are repeated turns.  Rows without ``conv_id`` belong to no
    conversation.  A conversation whose turns all went is a member of the root alone.  Texts of any
    length are compared whole.  Other columns are not read; an empty table gives no rows.

    The sequence of one conversation is one row, eight bytes a turn; the members of a node are not.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = turn_ids(turns)
    own = stored(own_sequences(ids), "own")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = stored(
        rebuilt(own).groupBy(F.floor(F.col("conv_id") / ENDS).alias("part"), "ids").agg(
            F.any_value("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("first"), listed.alias("ends")
        ),
        "runs",
    )
    dropped(ids, own)
    different = stored(
        runs.groupBy("ids").agg(F.any_value("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("first").alias("first")), "different"
    )
    shards = max(1, -(-different.count() // shard))
    ordered = different.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
    sequences = stored(ordered.withColumn("seq", F.monotonically_increasing_id()), "sequences")
    sequences = sequences.withColumn("shard", F.shiftright("seq", 33))
    # One row per shard from here on.
    bounds = sequences.groupBy("shard").agg(F.min_by("ids", "seq").alias("head"), F.max_by("ids", "seq").alias("tail"))
    bounds = stored(bounds, "bounds")
    numbers = sorted(r["shard"] for r in bounds.select("shard").collect())
    following = spark.createDataFrame(list(zip(numbers, numbers[1:])), "low long, up long")
    none = [F.lit(None).cast(c).alias(n) for c, n in (("array<bigint>", "bytes"), ("bigint", "n"), ("bigint", "first"), ("bigint", "seq"))]
    edges = [
        bounds.join(following, F.col("shard") == F.col(of)).select(F.col(to).alias("shard"), F.lit(kind).alias("kind"), F.col(column).alias("ids"), *none)
        for of, to, kind, column in (("low", "up", -1, "tail"), ("up", "low", 1, "head"))
    ]
    rows = sequences.select("shard", F.lit(0).alias("kind"), "ids", "bytes", "n", "first", "seq")
    for more in edges:
        rows = rows.unionByName(more)
    nodes = stored(rows.groupBy("shard").applyInPandas(_grown, NODE), "nodes")
    shared = nodes.where("key is not null").groupBy("key").agg(
        F.any_value("parent_key").alias("parent_key"), F.max("seq").alias("seq"), F.any_value("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    shared = stored(shared, "shared")
    tops = shared.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv_id"))
    columns = ["seq", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = nodes.where("key is null")
    inside = whole.where("parent_key is null").select(*columns, "parent_conv_id")
    hanging = whole.where("parent_key is not null").select(*columns, "parent_key").unionByName(shared.select(*columns, "parent_key"))
    hanging = hanging.join(tops, F.col("parent_key") == F.col("_key"), "left").select(*columns, F.col("_conv_id").alias("parent_conv_id"))
    every = inside.unionByName(hanging)
    numbered = runs.select("ids", "part", "ends").join(sequences.select(F.col("ids").alias("_ids"), "seq"), F.col("ids") == F.col("_ids"))
    ends = (
        numbered.select("seq", "part", "ends").repartition(parts, "seq").sortWithinPartitions("seq", "part")
        .mapInArrow(_hashed_ends, "seq long, ends_sha256 string").withColumnRenamed("seq", "_seq")
    )
    out = [*columns[1:], "parent_conv_id", "ends_sha256"]
    ended = every.where("seq is not null").join(ends, F.col("seq") == F.col("_seq")).select(*out)
    passed = every.where("seq is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(passed.select(*out))

"""N-gram Jaccard join by MinHash in bands of a fixed length (operator 8).

Documents are sets of word n-grams; equal sets are one class, so copies cost one row each.  Every
class has a MinHash signature for each of several bands, and classes whose signatures agree in a
band are candidates.  A forest would shorten the prefixes of sorted signatures until the recall is
reached; as threshold and recall are given, the length that this ends at is known beforehand, and
bands have it from the start.

Candidates are gathered into components, whose members are then compared exactly: a component is
dealt into chunks, each pair of chunks is one task's work, and the shared n-grams of two chunks are
counted by a matrix product.  A task returns one row per class, never the pairs: the number of
documents linked to it, and the tree of links that connects the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.batches import gram_hashes, mixed, slices, text_bytes, word_hashes, word_spans
from vacancylake.llm.graphs import components
from vacancylake.llm.tables import stored
from vacancylake.llm.windows import keyed

SLICE_BYTES = 1 << 20
COLUMNS = 8192


def matched_prefix(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix under which a pair of ``similarity`` shares one in some tree with ``recall``.

    A prefix of ``k`` values is shared with the probability ``similarity ** k`` in each tree.
    """
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the different word n-grams of each text, in order of their hashes.

    A text of fewer words has one gram of all its words.
    """
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(bounds)
    grams = mixed(gram_hashes(words, n)) if len(words) >= n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    place = np.arange(len(row)) - np.repeat(
        np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0), np.maximum(count - n + 1, 0)
    )
    values = grams[bounds[row] + place] if len(row) else grams[:0]
    short = np.flatnonzero((count > 0) & (count < n))
    whole = [mixed(gram_hashes(words[bounds[r] : bounds[r + 1]], int(count[r])) + np.uint64(count[r]))[0] for r in short]
    row = np.concatenate((row, short))
    values = np.concatenate((values, np.array(whole, dtype=np.uint64)))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[new], values[new]
    return values, np.searchsorted(row, np.arange(len(count) + 1))


def tree_keys(values: np.ndarray, bounds: np.ndarray, trees: int, length: int) -> np.ndarray:
    """For each non-empty set the hash of its prefix in each tree."""
    rng = np.random.default_rng(97)
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    keys = np.zeros((len(filled), trees), dtype=np.uint64)
    for tree in range(trees):
        key = np.full(len(filled), tree + 1, dtype=np.uint64)
        for _ in range(length):
            mask, factor = rng.integers(1, 2**63, 2, dtype=np.uint64)
            lowest = np.minimum.reduceat((values ^ mask) * (factor | np.uint64(1)), filled)
            key = mixed(key + lowest)
        keys[:, tree] = key
    return keys


def _signed(n: int, trees: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            values, bounds = shingles(batch.column(2), n)
            keys = tree_keys(values, bounds, trees, length)
            filled = np.flatnonzero(bounds[1:] > bounds[:-1])
            name = np.add.reduceat(mixed(values + np.uint64(7)), bounds[filled]) if len(filled) else values[:0]
            rows = pa.array(filled)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(mixed(name).view(np.int64)),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                ],
                names=["d", "t", "class", "keys"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            values, bounds = shingles(batch.column(2), n)
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["class", "members", "grams"]
            )

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` are at least that similar by Jaccard's measure."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
    shared = np.zeros((len(left), len(right)))
    for first in range(0, int(number[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(number, (first, first + COLUMNS))
        table = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        table[owner[a:b], number[a:b] - first] = 1
        shared += table[: len(left)] @ table[len(left) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return shared >= similarity * union - 1e-9


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the symmetric links ``pairs`` connect it with."""
    root = np.arange(n)
    while True:
        best = np.where(pairs, root[None, :], n).min(axis=1)
        after = np.minimum(root, best)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _compared(similarity: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        names, members = rows["class"].to_numpy(), rows["members"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        chunk = rows["chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        pairs = np.zeros((len(names), len(names)), dtype=bool)
        if len(left) and len(right):
            found = linked([sets[k] for k in left], [sets[k] for k in right], similarity)
            pairs[np.ix_(left, right)] = found
            pairs[np.ix_(right, left)] = found.T
        np.fill_diagonal(pairs, False)
        return pd.DataFrame(
            {"class": names, "links": (pairs * members[None, :]).sum(axis=1), "root": names[_roots(pairs, len(names))]}
        )

    return run


def join(
    docs: DataFrame,
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.9999,
    trees: int = 24,
    depth: int = 8,
    chunk_classes: int = 128,
) -> DataFrame:
    """``d, t, class, members, links, label`` of each different row that has a word.

    ``class`` names the set of n-grams, ``members`` are the rows that have it, ``links`` the rows of
    other classes at least ``similarity`` alike, ``label`` the connected group of classes.  ``d`` and
    ``t`` are those of ``keyed``.
    """
    length = matched_prefix(trees, depth, similarity, recall)
    rows = keyed(docs).select("d", "t", "text")
    signed = stored(
        rows.mapInArrow(_signed(n, trees, length), "d long, t long, class long, keys array<long>"), "signed"
    )
    classes = stored(
        signed.groupBy("class").agg(
            F.count("*").alias("members"), F.min(F.struct("d", "t")).alias("first"), F.min_by("keys", "d").alias("keys")
        ),
        "classes",
    )
    each = classes.select("class", F.explode("keys").alias("hub"))
    shared = each.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub")
    meeting = stored(each.join(shared, "hub").select(F.col("class").alias("node"), "hub"), "meeting")
    parts = components(meeting).select(F.col("node").alias("class"), F.col("label").alias("part"))
    sizes = parts.groupBy("part").agg(F.ceil(F.count("*") / chunk_classes).cast("int").alias("chunks"))
    candidates = classes.select("class", "members", "first.d", "first.t").join(parts, "class").join(sizes, "part")
    sets = (
        rows.join(candidates.select("class", "members", "d", "t"), ["d", "t"])
        .dropDuplicates(["class"])
        .select("class", "members", "text")
        .mapInArrow(_sets(n), "class long, members long, grams binary")
    )
    chunk = F.pmod(F.xxhash64("class", F.lit("chunk")), F.col("chunks")).cast("int")
    dealt = (
        sets.join(candidates.select("class", "part", "chunks"), "class")
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "part", "class", "members", "grams", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
        )
    )
    compared = stored(
        dealt.groupBy("part", "low", "high").applyInPandas(_compared(similarity), "class long, links long, root long"),
        "compared",
    )
    groups = components(
        compared.where("class != root")
        .select("class", "root")
        .distinct()
        .select(F.explode(F.array("class", "root")).alias("node"), F.xxhash64("class", "root").alias("hub"))
    )
    links = compared.groupBy("class").agg(F.sum("links").alias("links"))
    return (
        signed.select("d", "t", "class")
        .join(classes.select("class", "members"), "class")
        .join(links, "class", "left")
        .join(groups.select(F.col("node").alias("class"), "label"), "class", "left")
        .select(
            "d", "t", "class", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "class").alias("label")
        )
    )


def linked_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` of every row of ``docs`` (doc_id, text).

    ``n_links`` counts the other rows whose sets of word n-grams are at least ``similarity`` alike,
    copies included; ``copy_of`` is the smallest id with the same set, ``class_id`` the smallest id
    of all that links connect, however far.

    Rows without a word have no links and are their own class.  A text of fewer than ``n`` words
    equals only texts of the same words.  A null ``doc_id`` counts as larger than all others and is
    returned as null.  An empty table gives no rows.  Other columns are not read.
    """
    joined = stored(join(docs, **options), "joined")
    copies = joined.groupBy("class").agg(F.min("d").alias("copy_of"))
    groups = joined.groupBy("label").agg(F.min("d").alias("class_id"))
    found = (
        joined.join(copies, "class")
        .join(groups, "label")
        .select("d", "t", "class_id", "copy_of", (F.col("links") + F.col("members") - 1).alias("n_links"))
        .dropDuplicates(["d", "t"])
    )
    id_of = lambda c: F.when(F.coalesce(F.col(c), F.col("d")) < F.lit((1 << 63) - 1), F.coalesce(F.col(c), F.col("d")))
    return (
        keyed(docs)
        .select("doc_id", "d", "t")
        .join(found, ["d", "t"], "left")
        .select(
            "doc_id",
            id_of("class_id").alias("class_id"),
            id_of("copy_of").alias("copy_of"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, less those linked to a row that stays.

    Of each connected group the row with the smallest ``doc_id`` stays, of rows with that id the one
    with the smallest hash.  Rows without a word stay.  Rows equal in all columns are one.
    """
    names = docs.columns
    whole = F.xxhash64(*names)
    joined = join(docs, **options).dropDuplicates(["d", "t"])
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t"), whole.alias("h")
    )
    placed = narrow.join(joined.select("d", "t", "label"), ["d", "t"], "left")
    first = stored(
        placed.where("label is not null").groupBy("label").agg(F.min(F.struct("d", "t", "h")).alias("k")).select("k.*")
        .unionByName(placed.where("label is null").select("d", "t", "h").distinct()),
        "first",
    )
    keys = [f"_{c}_of_kept_row" for c in first.columns]
    first = first.toDF(*keys)
    marked = docs.withColumns(
        {
            "_d_of_row": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
            "_t_of_row": F.xxhash64("text"),
            "_h_of_row": whole,
        }
    )
    own = ["_d_of_row", "_t_of_row", "_h_of_row"]
    on = [F.col(a) == F.col(b) for a, b in zip(own, keys)]
    return marked.join(first, on, "left_semi").dropDuplicates(own).select(*names)

"""Merkle manifest of a dataset with a proof for every row (operator 11).

Nodes are told by nested intervals: each carries the ranks of the leaves it covers, ``lo`` to ``hi``.
The levels of a tree are cut into bands of ``BAND`` levels, and the nodes of a band into buckets,
each the part of the tree below one node at the top of the band.  On the way up a bucket is
gathered, at most 2 to the power of ``BAND`` nodes in a row, and its top goes on to the band above.
On the way down a bucket meets its top's place in the band above by a join on tree and bucket,
where the intervals must contain it; inside the bucket every node's ancestors are the nodes whose
intervals contain its own, and its sibling at a level is what remains of the parent's interval
without its own.  So a proof grows by a band at a time, a leaf moves twice (ranking and gathering),
and the bands above hold a thirty-second of the rows of the one below.

Leaves are ranked without bringing a tree together: rows are dealt by range, and the number of rows
of a tree in earlier ranges is added to the place in one's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylake.llm.tables import dropped, stored

#: Levels of a band; a bucket holds twice 2 to this power nodes at most.
BAND = 5
#: Rows whose checksum this number divides are tampered with.
TAMPERED = 7


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def encoded(value: str | Column) -> Column:
    """The UTF-8 bytes of a value as a decimal count, a colon and themselves; a dash for null."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, altered`` of every row; ``altered`` is the leaf of a row tampered with, else null."""

    def leaf(chars: Column) -> Column:
        return digest(encoded("doc_id"), encoded("source"), encoded("lang"), encoded(chars), encoded("text"))

    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = F.when(checksum % TAMPERED == 0, leaf(F.col("n_chars") + 1))
    return docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), changed.alias("altered"))


def ranked(rows: DataFrame, tree: str, order: list[Column], label: str) -> DataFrame:
    """``rows`` with ``rank``, counted from 0 within each ``tree`` in the given order; written.

    Rows that tie in all of it are dealt by a number of their own, so that no range holds them all.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(tree), *order, F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    placed = stored(
        dealt.sortWithinPartitions(*keys).drop("_tie").withColumn("_place", F.monotonically_increasing_id()), label
    )
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    # a row per range and tree that meet
    counts = placed.groupBy("_part", tree).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("_part").alias("_of_part"),
        F.col(tree).alias("_of_tree"),
        (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_shift"),
    )
    same = (F.col("_part") == F.col("_of_part")) & (F.col(tree) == F.col("_of_tree"))
    return placed.join(shifts, same).withColumn("rank", F.col("_place") - F.col("_shift")).drop(
        "_place", "_part", "_of_part", "_of_tree", "_shift"
    )


def _height(leaves_: Column) -> Column:
    """Levels above the leaves of a tree."""
    return F.when(leaves_ > 1, F.length(F.bin(leaves_ - 1))).otherwise(0)


def _parents(level: Column) -> Column:
    """The nodes above those of ``level``: two consecutive ones each, the last one maybe alone."""

    def parent(i: Column) -> Column:
        left, right = F.get(level, 2 * i), F.get(level, 2 * i + 1)
        return F.struct(
            left["lo"].alias("lo"),
            F.coalesce(right["hi"], left["hi"]).alias("hi"),
            digest(left["digest"], F.coalesce(right["digest"], F.lit(""))).alias("digest"),
        )

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1), parent)


def _buckets(nodes: DataFrame, band: int) -> DataFrame:
    """``tree, bucket, height, members, nodes, top`` of one band, gathered from the nodes at its foot."""
    shift = band * BAND
    rows = nodes.withColumn("bucket", F.shiftright("lo", shift + BAND)).groupBy("tree", "bucket", "height").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", "own"))).alias("members")
    )
    rows = rows.withColumn("levels", F.least(F.lit(BAND), F.col("height") - shift))
    foot = F.transform("members", lambda m: F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), m["digest"].alias("digest")))
    rows = rows.withColumn("l0", foot)
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string>>")
    for j in range(BAND):
        rows = rows.withColumn(f"l{j + 1}", F.when(F.col("levels") > j, _parents(F.col(f"l{j}"))).otherwise(none))

    def at_level(j: int) -> Column:
        return F.transform(
            f"l{j}", lambda n: F.struct(F.lit(j).alias("level"), n["lo"].alias("lo"), n["hi"].alias("hi"), n["digest"].alias("digest"))
        )

    rows = rows.withColumn("nodes", F.concat(*[at_level(j) for j in range(BAND + 1)]))
    return rows.select("tree", "bucket", "height", "members", "nodes", F.element_at("nodes", -1).alias("top"))


def grown(leaf_nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The bands of all trees, from the leaves up, and ``tree, digest`` of their roots.

    ``leaf_nodes``: ``tree, rank, digest, own``.
    """
    sizes = leaf_nodes.groupBy("tree").agg(_height(F.count("*")).alias("height"))
    sizes = stored(sizes.withColumnRenamed("tree", "_of"), f"{label}-sizes")
    nodes = leaf_nodes.join(sizes, F.col("tree") == F.col("_of")).select(
        "tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "own", "height"
    )
    highest = sizes.agg(F.max("height")).first()[0] or 0
    bands, roots = [], None
    for band in range(max(1, -(-highest // BAND))):
        rows = stored(_buckets(nodes, band), f"{label}-band")
        bands.append(rows)
        ended = rows.where(F.col("height") <= (band + 1) * BAND).select("tree", F.col("top.digest").alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = rows.where(F.col("height") > (band + 1) * BAND).select(
            "tree", "top.lo", "top.hi", "top.digest", F.lit(None).cast("int").alias("own"), "height"
        )
    dropped(sizes)
    return bands, roots


#: Siblings from a node up to a root; null where the node is alone in its run, ``left`` if the node comes first.
PATH = "array<struct<digest:string,left:boolean>>"


def _siblings(nodes: Column, chain: Column) -> Column:
    """What each node of ``chain``, from the foot up, has beside it in its parent's interval."""

    def sibling(node: Column, i: Column) -> Column:
        parent = F.get(chain, i + 1)
        left = node["lo"] == parent["lo"]
        start = F.when(left, node["hi"]).otherwise(parent["lo"])
        end = F.when(left, parent["hi"]).otherwise(node["lo"])
        found = F.filter(nodes, lambda n: (n["level"] == node["level"]) & (n["lo"] >= start) & (n["hi"] <= end))
        return F.struct(F.get(found, F.lit(0))["digest"].alias("digest"), left.alias("left"))

    return F.transform(F.slice(chain, 1, F.size(chain) - 1), sibling)


def proofs(bands: list[DataFrame], above_roots: DataFrame) -> DataFrame:
    """``tree, lo, digest, own, path`` of every leaf; ``above_roots``: ``tree, path`` from a tree's root on."""
    above = None
    for band in reversed(range(len(bands))):
        rows = bands[band]
        tops = above_roots.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"))
        here = rows.where(F.col("height") <= (band + 1) * BAND).join(tops, F.col("tree") == F.col("_tree"))
        if above is not None:
            reached = above.select(
                F.col("tree").alias("_tree"), F.shiftright("lo", (band + 1) * BAND).alias("_bucket"),
                F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("path").alias("_path"),
            )
            contains = (F.col("_lo") <= F.col("top.lo")) & (F.col("_hi") >= F.col("top.hi"))
            below = rows.join(reached, (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket")) & contains)
            here = here.select(*rows.columns, "_path").unionByName(below.select(*rows.columns, "_path"))
        each = here.select("tree", "nodes", "_path", F.explode("members").alias("m"))
        chain = F.filter("nodes", lambda n: (n["lo"] <= F.col("m.lo")) & (n["hi"] >= F.col("m.hi")))
        each = each.withColumn("chain", chain)
        above = each.select(
            "tree", "m.lo", "m.hi", "m.digest", "m.own", F.concat(_siblings(F.col("nodes"), F.col("chain")), "_path").alias("path")
        )
        if band:
            above = stored(above.drop("own"), "paths")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""

    def up(below: Column, s: Column) -> Column:
        beside = F.coalesce(s["digest"], F.lit(""))
        return F.when(s["left"], digest(below, beside)).otherwise(digest(beside, below))

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    A tree for each ``lang``, its leaves in the order of ``doc_id``, and one over the roots of these,
    in the order of ``lang``.  ``folded_root`` is computed from the leaf, that of a tampered row from
    its altered one, and the original siblings.

    Nulls in hashed columns are a dash; a null ``lang`` is a language of its own that comes first.  A
    null ``doc_id`` comes first in its tree and is never tampered with; rows that share one come in
    the order of their leaves, and equal rows are equal leaves, each with its own proof.  A tree of
    one leaf is that leaf, and the proof of an only row is the hash of nothing.  Texts of any length
    are hashed whole.  Other columns are not read; an empty table gives no rows.
    """
    read = stored(leaves(docs), "leaves")
    langs = ranked(read.select("lang").distinct().withColumn("tree", F.lit(0)), "tree", [F.asc_nulls_first("lang")], "langs")
    langs = stored(langs.select(F.col("lang").alias("_lang"), F.col("rank").alias("tree")), "langs")
    rows = read.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang", "lang")
    rows = ranked(rows, "tree", [F.asc_nulls_first("doc_id"), F.col("leaf")], "ranks")
    own = F.struct("doc_id", "altered").alias("own")
    bands, subroots = grown(rows.select("tree", "rank", F.col("leaf").alias("digest"), own), "tree")
    subroots = stored(subroots, "subroots")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest", F.col("tree").alias("own"))
    root_bands, root = grown(upper, "root")
    root = stored(root.select(F.col("digest").alias("root")), "root")
    nothing = root.select(F.lit(0).cast("long").alias("tree"), F.array().cast(PATH).alias("path"))
    tops = stored(proofs(root_bands, nothing).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path"), "tops")
    found = proofs(bands, tops.select("tree", "path"))
    found = found.join(tops.select(F.col("tree").alias("_tree"), "subroot"), F.col("tree") == F.col("_tree"))
    found = found.join(root, how="cross")  # a single row
    siblings = F.array_join(F.transform("path", lambda s: s["digest"]), "")  # leaves nulls out
    out = found.select(
        F.col("own.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        digest(siblings).alias("proof_sha256"),
        folded(F.coalesce("own.altered", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

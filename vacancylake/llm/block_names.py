"""Exact deduplication by deterministic block naming (operator 13).

DataFrame functions only.  A text is cut into blocks of fixed size.  All blocks of the corpus are
sorted, and the place of a block in that order is its integer name.  Then adjacent names are paired,
all pairs are sorted and named likewise, and so on until each document has one name: its identity.
At every step equal names stand for equal stretches of text, so texts are equal when they got the
same name after the same number of steps; nothing rests on a hash being free of collisions.

Every block is a row, so a long text needs no long row beyond its own.  Steps after the first look
at documents of several blocks only, and each works on half the rows of the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.naming import ambiguous, fingerprint, sorted_names, told_apart, with_names
from vacancylake.llm.tables import dropped, stored

#: Characters that don't count: space, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = " \t\n\x0b\x0c\r"
BLOCK = 4096


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), IGNORED, "")


def blocks(text: Column, size: int) -> Column:
    """``text`` cut into runs of ``size`` characters, the last one shorter; an empty text is one block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.octet_length(text) <= size, F.array(text)).otherwise(cut)


def identities(docs: DataFrame, text: Column, *, size: int = BLOCK, carried: dict[str, Column] | None = None) -> DataFrame:
    """``(row, steps, name, ...)`` for every row of ``docs``, with the ``carried`` columns; written.

    Texts are equal when both ``steps`` and ``name`` are.  Rows are numbered by where they stand.
    """
    carried = carried or {}
    cut = docs.select(blocks(text, size).alias("_b"))
    seen = cut.select(F.explode("_b").alias("value")).select(fingerprint("value").alias("print"), "value")
    doubtful = stored(ambiguous(seen), "doubtful")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), blocks(text, size).alias("_b"), *[c.alias(f"c_{n}") for n, c in carried.items()])
    rows = rows.select("row", F.size("_b").alias("n"), *[f"c_{n}" for n in carried], F.posexplode("_b").alias("at", "value"))
    # what is carried along is kept at the first block of a row only
    kept = [F.when(F.col("at") == 0, F.col(f"c_{n}")).alias(f"c_{n}") for n in carried]
    places = told_apart(rows.select("row", "n", "at", fingerprint("value").alias("print"), "value", *kept), doubtful)
    places = stored(places, "places")
    first = sorted_names(places, ["print", "value"], "name", "block-names")
    current = with_names(places, first, ["print", "value"])
    found = current.where("n = 1").drop("at", "n").withColumn("steps", F.lit(0))
    heads = places.where("n > 1 and at = 0").drop("n", "at", "print", "value")
    current = stored(current.where("n > 1").select("row", "n", "at", "name"), "named")
    tables = [doubtful, places, first, current]
    done, step = None, 0
    while not current.isEmpty():
        step += 1
        left = F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left")
        right = F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right")
        pairs = current.groupBy("row", F.floor(F.col("at") / 2).alias("at"), F.ceil(F.col("n") / 2).alias("n")).agg(left, right)
        pairs = stored(pairs, "pairs")
        names = sorted_names(pairs, ["left", "right"], "name", "pair-names")
        after = stored(with_names(pairs, names, ["left", "right"]), "named")
        ended = after.where("n = 1").select("row", "name", F.lit(step).alias("steps"))
        done = ended if done is None else done.unionByName(ended)
        dropped(pairs, names)
        tables.append(after)
        current = after.where("n > 1")
    if done is not None:
        found = found.unionByName(heads.join(done, "row"))
    out = stored(found.select("row", "steps", "name", *[F.col(f"c_{n}").alias(n) for n in carried]), "identities")
    dropped(*tables)
    return out


def deduplicate(docs: DataFrame, *, size: int = BLOCK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when they are after the characters of ``IGNORED`` are taken out.  Of equal ones
    the row whose original text has the most code points stays, then the smallest ``doc_id``, then
    the row that stands first.

    A null text counts as empty, and empty texts equal each other.  A null ``doc_id`` comes after
    all others; a repeated one makes rows of their own, of which one stays.  Texts of any length
    are compared whole.  Other columns are not read; an empty table gives no rows.
    """
    norm = normalised("text")
    rows = identities(
        docs,
        norm,
        size=size,
        carried={
            "doc_id": F.col("doc_id"),
            "points": F.char_length(F.coalesce("text", F.lit(""))),
            "text_sha256": F.sha2(norm.cast("binary"), 256),
        },
    )
    # The least of these is the row that stays; one row per group leaves each task.
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = rows.groupBy("steps", "name").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(
        F.col("steps").alias("_steps"), F.col("name").alias("_name"), "group_size",
        F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
    )
    same = (F.col("steps") == F.col("_steps")) & (F.col("name") == F.col("_name"))
    return rows.join(groups, same).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )

"""Integer names for values of any length: equal values get one name, different values different ones.

Values are put in the order of a 64-bit fingerprint and, where the fingerprints of different values
meet, in their own order; the place in that order is the name.  A value itself is compared with
those of its own fingerprint only, so it moves once, and only one copy of it out of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylake.llm.tables import stored


def fingerprint(value: str | Column) -> Column:
    return F.xxhash64(value)


def ambiguous(values: DataFrame) -> DataFrame:
    """``(print)``: fingerprints that different values share, of ``values`` (print, value)."""
    kinds = values.groupBy("print").agg(F.count_distinct("value").alias("kinds"))
    return kinds.where("kinds > 1").select("print")


def told_apart(places: DataFrame, doubtful: DataFrame) -> DataFrame:
    """``places`` (print, value, ...) with ``value`` only where the fingerprint alone doesn't tell.

    64 bits rarely meet, so ``doubtful`` hardly ever has a row; the planner broadcasts it by its
    size, and however many there are, the result is the same.
    """
    marked = doubtful.select(F.col("print").alias("_print"))
    joined = places.join(marked, F.col("print") == F.col("_print"), "left")
    return joined.withColumn("value", F.when(F.col("_print").isNotNull(), F.col("value"))).drop("_print")


def sorted_names(df: DataFrame, keys: list[str], name: str, label: str) -> DataFrame:
    """The different ``keys`` of ``df`` with an integer ``name`` that grows in their order; written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = df.select(*keys).distinct()
    ordered = different.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), label)


def with_names(df: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the name of its ``keys``, of which nulls equal each other, in their place."""
    renamed = names.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in names.columns if c not in keys])
    first, *rest = keys
    same = F.col(first) == F.col(f"_{first}")
    for k in rest:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(renamed, same).drop(*keys, *[f"_{k}" for k in keys])

"""Membership joins, first rows by key, and keyed updates.

Sizes are left to the planner, which sees them in bytes when it runs: small key sets are broadcast,
others are shuffled, and of shuffled rows only keys that turn out heavy are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers as keys, some 20 bytes each in memory, that may be sent to every task.
MOST_BROADCAST = 4_000_000


def may_be_broadcast(keys: DataFrame, key: str) -> bool:
    """The keys are so few that every task can hold them, while the planner may think otherwise; counts them."""
    return isinstance(keys.schema[key].dataType, T.IntegralType) and keys.count() <= MOST_BROADCAST


def member_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys; counted down per partition before anything is shuffled."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def filter_members(
    df: DataFrame, keys: DataFrame, key: str, *, keep: bool, row_id: str = "job_id", hint: str | None = None
) -> DataFrame:
    """Rows of ``df`` whose key is (``keep``) or is not among ``keys``; rows without key never are.

    Rows without key are dealt by their own id, so that they don't meet in one task.  ``hint`` names
    a join strategy where the planner's choice is not wanted; with ``broadcast`` no row is dealt.
    """
    members = member_keys(keys, key).select(F.col(key).alias("_member"))
    members = members.hint(hint) if hint else members
    if keep:
        return df.join(members, F.col(key) == F.col("_member"), "left_semi")
    if hint == "broadcast":
        return df.join(members, F.col(key) == F.col("_member"), "left_anti")
    dealt = F.coalesce(F.col(key).cast("string"), F.xxhash64(row_id).cast("string"))
    rows = df.withColumns({"_has": F.col(key).isNotNull(), "_key": dealt})
    members = members.select(F.col("_member").cast("string").alias("_key"), F.lit(True).alias("_has"))
    return rows.join(members, ["_key", "_has"], "left_anti").select(*df.columns)


def first_by_key(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest keys, in the partitions they are in.

    The last key is found on the keys alone, by one job, and the rows are filtered by it.  Rows
    without key come last; of rows that share the last key as many as fit are taken.
    """
    ordered = df.select(F.col(key).alias("k")).orderBy(F.asc_nulls_last("k")).limit(limit)
    last = ordered.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc_nulls_first("k")).limit(1).collect()
    if not last:
        return df.limit(0)
    end, n = last[0]["k"], last[0]["n"]
    before = F.col(key).isNotNull() if end is None else F.col(key) < F.lit(end)
    tied = df.where(F.col(key).eqNullSafe(F.lit(end))).limit(n)
    return df.where(before).unionByName(tied)


def update_by_key(
    base: DataFrame,
    updates: DataFrame,
    key: str,
    columns: list[str] | None = None,
    latest: str | None = None,
) -> DataFrame:
    """``base`` with the given columns set where ``updates`` has a row of the same key.

    Columns new to ``base`` are added, NULL elsewhere.  Updates without key, or with one that
    ``base`` lacks, change nothing.  Of several updates of one key the one with the greatest
    ``latest`` counts, then the one with the greatest text, so each row of ``base`` stays one row.
    """
    columns = [c for c in (columns or updates.columns) if c != key]
    taken = F.struct(*columns)
    rank = F.struct(*([F.col(latest)] if latest else []), F.to_json(taken, {"ignoreNullFields": "false"}))
    new = (
        updates.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(taken, rank).alias("_new"), F.lit(True).alias("_hit"))
    )
    keyed = base.where(F.col(key).isNotNull()).join(new, key, "left")
    kept = [
        F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else c
        for c in base.columns
    ]
    added = [F.col(f"_new.{c}").alias(c) for c in columns if c not in base.columns]
    # Rows without key would all meet in one task of the join, so they go around it.
    return keyed.select(*kept, *added).unionByName(
        base.where(F.col(key).isNull()), allowMissingColumns=True
    )


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a wanted key, and the wanted keys no row has.

    Only the keys that survive the first join are looked at for the second.
    """
    found = filter_members(rows, wanted, key, keep=True)
    present = filter_members(rows.select(key), wanted, key, keep=True)
    missing = filter_members(member_keys(wanted, key), present, key, keep=False, row_id=key)
    return found, missing

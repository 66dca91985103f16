"""Small array helpers used across the extraction functions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def size0(array: Column) -> Column:
    """Element count, 0 for a missing array."""
    return F.size(F.coalesce(array, F.array()))


def non_empty(array: Column) -> Column:
    """The array exists and holds at least one element."""
    return size0(array) > 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    Values captured by a higher-order function would otherwise be evaluated anew for
    every element, since lambdas take no part in common-subexpression elimination.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value: object, schema: T.DataType) -> Column:
    """A nested Python value as one literal; folded at planning time."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def drop_members(array: Column, other: Column) -> Column:
    """Elements of ``array`` absent from ``other``; duplicates stay."""
    return F.filter(array, lambda x: ~F.array_contains(other, x))


def tagged(array: Column, tag: str | int, name: str = "kind", value: str = "value") -> Column:
    """Elements as structs that carry a constant tag."""
    return F.transform(array, lambda x: F.struct(F.lit(tag).alias(name), x.alias(value)))


def select_where(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """The given columns of the rows that meet a condition on computed columns.

    As a filter the condition would be pushed below the projections that compute its inputs,
    and those be computed twice; a generator of no or one element stays where it is.
    """
    row = F.struct(*columns)
    return df.select(F.explode(F.when(condition, F.array(row))).alias("_row")).select("_row.*")

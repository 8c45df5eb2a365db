"""Null rules that differ between Spark and the analyses' own null model."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that stands for a missing name in wide tables and in CSV files.
NA = "NA"


def is_in(col: Column, values: Iterable) -> Column:
    """Set membership where null is not a member, also under ``~``."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def na_text(col: Column) -> Column:
    """Null as the text ``NA``, for column names made from values."""
    return F.coalesce(col.cast("string"), F.lit(NA))


def holds(cond: Column) -> Column:
    """A condition with null counted as false."""
    return F.coalesce(cond, F.lit(False))


def ascending(*cols: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def descending(*cols: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in cols]


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from the left side.

    ``<=>`` still plans as a hash or sort-merge join.
    """
    marked = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    same = reduce(and_, [left[c].eqNullSafe(marked[f"__right_{c}"]) for c in on])
    return left.join(marked, same, how).drop(*[f"__right_{c}" for c in on])

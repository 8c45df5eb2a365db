"""Frequency tables, counts and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import month_key
from sojourn.functions.nulls import ascending, descending
from sojourn.operators.topk import top_n


def count_by(df: DataFrame, *keys: str, name: str = "count", weight: str | None = None) -> DataFrame:
    """Rows per key, in no order; null is a key. ``weight`` is the number of times a row counts."""
    return df.groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias(name))


def freq(
    df: DataFrame,
    *keys: str,
    n: int | None = None,
    sort: str = "count",
    name: str = "count",
    weight: str | None = None,
) -> DataFrame:
    """Rows per key, commonest first (``sort="count"``) or in key order (``sort="key"``).

    Null is a key. Ties are in key order. ``n`` keeps the first rows of the table. ``weight`` is the
    number of times a row counts.
    """
    counted = count_by(df, *keys, name=name, weight=weight)
    by_key = ascending(*keys)
    order = [*descending(name), *by_key] if sort == "count" else by_key
    return counted.orderBy(*order) if n is None else top_n(counted, order, n)


def table_of(df: DataFrame, col: str) -> DataFrame:
    """One-way table of a column in value order; nulls are left out."""
    return freq(df.where(F.col(col).isNotNull()), col, sort="key")


def count_by_month(df: DataFrame, day: str, name: str = "month_year") -> DataFrame:
    return freq(df.withColumn(name, month_key(F.col(day))), name, sort="key")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def n_people(df: DataFrame, on: str, name: str = "n_people") -> DataFrame:
    """Number of distinct ids, with a null id counted once."""
    return df.select(on).distinct().agg(F.count("*").alias(name))


def n_people_by(df: DataFrame, keys: list[str], on: str, name: str = "n_people") -> DataFrame:
    """Distinct ids per key, null counted once: one row per key and id first, so a hot key is spread."""
    return df.select(*keys, on).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def share(cond: Column, weight: Column | None = None) -> Column:
    """Aggregate: the part of the rows that meet a condition, over rows where it is known."""
    met = cond.cast("double")
    if weight is None:
        return F.avg(met)
    return F.sum(met * weight) / F.sum(F.when(met.isNotNull(), weight))


def null_count(col: Column) -> Column:
    """Aggregate: number of nulls."""
    return F.count_if(col.isNull())

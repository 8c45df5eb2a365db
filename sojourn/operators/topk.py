"""Sorts with a limit, and row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending, descending, join_null_safe
from sojourn.session import write_once


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in an order that leaves no ties; each task sends at most ``n`` rows."""
    return df.orderBy(*order).limit(n)


def top_n_with_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """The rows with the ``n`` highest values of ``by``, and all rows tied with the last of them."""
    bar = df.orderBy(*descending(by)).limit(n).agg(F.min(by).alias("bar"))
    return df.where(F.col(by) >= bar.scalar())


def top_paths(df: DataFrame, path: str, n: int, extra_keys: Sequence[str] = ()) -> DataFrame:
    """All rows on the paths that occur in the ``n`` commonest combinations of path and extra keys.

    The rows are chosen by path alone, so fewer than ``n`` different paths may remain. The chosen
    paths, ``n`` rows at most, are broadcast.
    """
    keys = [path, *extra_keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("count"))
    common = top_n(counted, [*descending("count"), *ascending(*keys)], n).select(path)
    return df.join(F.broadcast(common), path, "left_semi")


def sorted_once(df: DataFrame, order: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """The rows in a global order, written once, with the columns to keep: ``part`` and ``at`` tell a row's file and place.

    ``at`` grows along the order, within a part by 1. The sort spreads even a single key over many parts.
    """
    ordered = df.orderBy(*order).select(*(keep or df.columns), F.monotonically_increasing_id().alias("at"))
    ordered = write_once(ordered)
    # the upper bits of the id are the partition, the lower ones count its rows
    return ordered.withColumn("part", F.shiftright("at", 33))


def with_row_index(
    df: DataFrame, order: Sequence[Column], name: str = "row_index", by: Sequence[str] = ()
) -> DataFrame:
    """Number the rows from 1 in the given order, over all rows or per ``by`` key, in a first column.

    After one global sort a part only has to know how many rows of a key lie in the parts before it.
    """
    keys = list(by)
    rows = sorted_once(df, [*ascending(*keys), *order])
    runs = rows.groupBy("part", *keys).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts = _starts(runs, keys, "n").select("part", *keys, "first", "before")
    position = F.col("before") + F.col("at") - F.col("first") + 1
    return join_null_safe(rows, starts, ["part", *keys]).select(position.alias(name), *df.columns)


def with_running_sum(df: DataFrame, order: Sequence[Column], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``upto``, the sum of ``value`` up to a row in the given order, and ``total``; per ``by`` key.

    As in :func:`with_row_index` a key may be spread over many parts; a window sees the rows that a part
    has of a key.
    """
    keys = list(by)
    rows = sorted_once(df, [*ascending(*keys), *order])
    runs = rows.groupBy("part", *keys).agg(F.sum(value).alias("n"))
    starts = _starts(runs, keys, "n").select("part", *keys, "before", "total")
    here = Window.partitionBy("part", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("upto", F.sum(value).over(here))
    joined = join_null_safe(within, starts, ["part", *keys])
    return joined.select(*df.columns, (F.col("before") + F.col("upto")).alias("upto"), "total")


def _starts(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of a key over the parts before, and over all. Without keys that is a row per part."""
    parts = Window.partitionBy(*keys).orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = runs.withColumns(
        {"before": F.coalesce(F.sum(value).over(earlier), F.lit(0)), "total": F.sum(value).over(whole)}
    )
    return write_once(starts)

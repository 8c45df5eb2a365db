"""One row per episode, per person, or per person's whole history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending
from sojourn.operators.topk import with_row_index


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order.

    Spark keeps one row per key in each map task before the shuffle, so a hot key stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def latest(df: DataFrame, on: str, time: str, tiebreak: Sequence[str]) -> DataFrame:
    """Last row per id in order of time, where a missing time counts as the last."""
    order = [F.col(c).desc_nulls_first() for c in (time, *tiebreak)]
    return dedupe_first(df, [on], order)


def history(df: DataFrame, on: str, time: str, path: str, tiebreak: Sequence[str]) -> DataFrame:
    """The path strings of every id in order of time: ``(on, position, path)``, with positions from 1.

    This is the joined text of an id in a form that needs no row of unbounded length; a missing time
    comes last, as it does for :func:`latest`. One global sort spreads also a single id.
    """
    rows = df.select(on, time, *tiebreak, path)
    return with_row_index(rows, ascending(time, *tiebreak), "position", by=[on]).select(on, "position", path)


def collapse_episodes(df: DataFrame, on: str, time: str, n_stints: str) -> DataFrame:
    """One row per id: its first time, the sum of its stints, and its number of rows."""
    return df.groupBy(on).agg(
        F.min(time).alias(time), F.sum(n_stints).alias(n_stints), F.count("*").alias("n_rows")
    )

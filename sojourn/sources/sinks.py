"""CSV sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sojourn.functions.nulls import NA
from sojourn.operators.topk import with_row_index
from sojourn.sources.tables import UNITS, part_name


def sink_csv(
    df: DataFrame,
    path: str,
    index: Sequence[Column] | None = None,
    mode: str = "errorifexists",
    measure: Mapping[str, Column] | None = None,
) -> dict:
    """Write CSV with a header; missing values as ``NA``.

    Each task writes its own part file. With ``index`` the rows are numbered from 1 in that
    order, in a first column ``row_index``. ``measure`` names aggregates that the job takes of the rows it writes;
    they are returned.
    """
    if index is not None:
        df = with_row_index(df, index)
    seen = Observation()
    if measure:
        df = df.observe(seen, *[value.alias(name) for name, value in measure.items()])
    df.write.mode(mode).csv(path, header=True, nullValue=NA, dateFormat="yyyy-MM-dd")
    return seen.get if measure else {}


def sink_dated(df: DataFrame, path: str, day: str, unit: str = "month", mode: str = "errorifexists") -> None:
    """Write Parquet laid out by the month (or year, or day) of a date or timestamp, for :func:`scan_period`.

    Rows are dealt by ranges of the day, so a month with most of the rows is written by many tasks, and a task writes
    few months. Rows without a day get a folder of their own.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    named = df.withColumn(part_name(day, unit), F.to_date(F.date_trunc(unit, F.col(day))))
    named.repartitionByRange(F.col(day)).write.mode(mode).partitionBy(part_name(day, unit)).parquet(path)

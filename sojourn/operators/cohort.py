"""Choosing rows: flags, cohorts, key lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sojourn.functions.nulls import join_null_safe
from sojourn.session import write_once


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Keep the rows whose flag is false; a null flag drops the row too."""
    return df.where(~F.col(flag))


def people(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The distinct keys of a table."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.select(*keys).distinct()


def restrict_to(df: DataFrame, cohort: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the cohort; null is a key like any other."""
    keys = [on] if isinstance(on, str) else list(on)
    return join_null_safe(df, people(cohort, keys), keys, "left_semi")


def restrict_to_ids(df: DataFrame, on: str, ids: Iterable) -> DataFrame:
    """Rows whose key is in a list; a null in the list matches null keys, as in :func:`restrict_to`.

    The list becomes a written table, so the plan does not grow with it; Spark knows the table's size, broadcasts a
    short list, and can put a Bloom filter of a long one below the shuffle.
    """
    kind = df.schema[on].dataType
    listed = pa.table({on: pa.array(dict.fromkeys(ids), to_arrow_type(kind))})
    return restrict_to(df, write_once(df.sparkSession.createDataFrame(listed).select(F.col(on).cast(kind))), on)


def only_in(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    keys = [on] if isinstance(on, str) else list(on)
    return join_null_safe(people(left, keys), people(right, keys), keys, "left_anti")


def repeated(df: DataFrame, on: str | Sequence[str], more_than: int = 1) -> DataFrame:
    """Keys with more than ``more_than`` rows, with their count."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > more_than)

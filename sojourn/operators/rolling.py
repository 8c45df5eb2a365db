"""Rolling means over a daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.nulls import join_null_safe


def rolling_mean_centered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    k: int = 7,
    fill: float = 0.0,
    out: str = "rolling_avg",
) -> DataFrame:
    """Mean of the ``k`` rows around each row of its series; rows without a full frame get ``fill``.

    The frame counts rows, so a day without a row widens it. ``df`` has one row per series and
    day, which bounds a window group by the calendar. ``k`` is odd. A null inside the frame gives null.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd")
    around = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()).rowsBetween(-(k // 2), k // 2)
    full = F.count("*").over(around) == k
    known = F.count(value).over(around) == k
    mean = F.when(known, F.avg(value).over(around))
    return df.withColumn(out, F.when(full, mean).otherwise(F.lit(float(fill))))


def densify(df: DataFrame, keys: Sequence[str], day: str, value: str, fill: float | int = 0) -> DataFrame:
    """A row for every day between a series' first and last one; days that were missing get ``fill``.

    ``df`` has one row per series and day. Put before :func:`rolling_mean_centered` it makes the frame
    count days. A row without a day is left out.
    """
    dated = df.where(F.col(day).isNotNull())
    spans = dated.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = spans.select(*keys, F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias(day))
    filled = join_null_safe(days, dated.select(*keys, day, F.col(value).alias("known")), [*keys, day], "left")
    return filled.select(*keys, day, F.coalesce("known", F.lit(fill)).alias(value))

"""Arrest counts: by day and state, by country, by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import as_date, in_period
from sojourn.functions.text import title_case
from sojourn.operators.cohort import only_in
from sojourn.operators.counts import count_by, freq
from sojourn.operators.pivot import pivot_wide
from sojourn.operators.rolling import rolling_mean_centered
from sojourn.operators.topk import top_n_with_ties

DAY = "apprehension_date"
STATE = "apprehension_state"


def daily_by_state(arrests: DataFrame) -> DataFrame:
    return count_by(arrests, DAY, STATE, name="arrests")


def daily_wide(arrests: DataFrame, after, states: Sequence[str] | None = None) -> DataFrame:
    """Arrests per day, one column per state, for the days after ``after``."""
    daily = daily_by_state(arrests.where(in_period(as_date(F.col(DAY)), after)))
    return pivot_wide(daily, [DAY], STATE, "arrests", states)


def rolling_wide(arrests: DataFrame, after, states: Sequence[str] | None = None, k: int = 7) -> DataFrame:
    """Centered rolling mean of the daily counts, one column per state and one row per day.

    The mean is taken before the days are cut off, so the first days shown have full frames.
    """
    rolled = rolling_mean_centered(daily_by_state(arrests), [STATE], DAY, "arrests", k)
    shown = rolled.where(in_period(as_date(F.col(DAY)), after))
    return pivot_wide(shown.select(DAY, STATE, "rolling_avg"), [DAY], STATE, "rolling_avg", states)


def by_country(arrests: DataFrame) -> DataFrame:
    counted = freq(arrests, "citizenship_country")
    return counted.withColumn("citizenship_country", title_case(F.col("citizenship_country")))


def top_countries(arrests: DataFrame, n: int = 10) -> DataFrame:
    """The countries with the ``n`` highest counts, ties with the last included."""
    found = top_n_with_ties(count_by(arrests, "citizenship_country"), "count", n)
    return found.withColumn("citizenship_country", title_case(F.col("citizenship_country")))


def daily_after(arrests: DataFrame, after) -> DataFrame:
    """Arrests per day after a date, in order of the days; the day itself is not shown."""
    return freq(arrests.where(in_period(F.col(DAY), after)), DAY, sort="key", name="arrests").select("arrests")


def type_by_day(arrests: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Arrests per day, one column per type, 0 where there were none."""
    counted = count_by(arrests, DAY, "apprehension_type")
    return pivot_wide(counted, [DAY], "apprehension_type", "count", types, fill=0)


def type_by_period(arrests: DataFrame, periods: dict[str, tuple]) -> DataFrame:
    """Arrests per type in each of several periods ``name: (lo, hi, closed)``, and their share, in one job.

    A row counts in every period it lies in; a row outside all of them counts in none.
    """
    day = F.col(DAY)
    names = [F.when(in_period(day, lo, hi, closed), F.lit(name)) for name, (lo, hi, closed) in periods.items()]
    tagged = arrests.select("apprehension_type", F.explode(F.array_compact(F.array(*names))).alias("period"))
    by_type = tagged.groupBy("period", "apprehension_type").agg(F.count("*").alias("count"))
    totals = by_type.groupBy("period").agg(F.sum("count").alias("total"))
    return by_type.join(totals, "period").select(
        "period", "apprehension_type", "count", (F.lit(100.0) * F.col("count") / F.col("total")).alias("percent")
    )


def held_not_arrested(stays: DataFrame, arrests: DataFrame, on: str = "unique_identifier") -> DataFrame:
    """Ids that have a stay but no arrest."""
    return only_in(stays, arrests, on)


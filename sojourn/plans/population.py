"""Daily facility population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.pivot import pivot_wide
from sojourn.operators.rolling import rolling_mean_centered

CODE = "detention_facility_code"


def population_wide(population: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """People held per day, one column per facility."""
    return pivot_wide(population, ["date"], CODE, "n_detained", codes)


def rolling_population(population: DataFrame, codes: Sequence[str] | None = None, k: int = 7) -> DataFrame:
    """Centered rolling mean per facility in order of date, one column per facility."""
    rolled = rolling_mean_centered(population, [CODE], "date", "n_detained", k)
    return pivot_wide(rolled.select("date", CODE, "rolling_avg"), ["date"], CODE, "rolling_avg", codes)


def days_in_use(population: DataFrame, code: str) -> DataFrame:
    """The days on which a facility held anyone. Filtered in the long table, so nothing is pivoted."""
    here = population.where((F.col(CODE) == code) & (F.col("n_detained") > 0))
    return here.select("date", "n_detained")

"""Detainer requests: per day and month, and by what became of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import in_period, parse_ymd
from sojourn.operators.cohort import drop_flagged
from sojourn.operators.counts import count_by_month, freq
from sojourn.operators.pivot import pivot_with_total

DAY = "detainer_prepare_date"
SITE = "detention_facility"
REASON = "detainer_lift_reason"


def cleaned(detainers: DataFrame) -> DataFrame:
    """Without flagged duplicates, the text dates parsed; a text that is no date becomes null."""
    return drop_flagged(detainers, "duplicate_likely").withColumn(DAY, parse_ymd(F.col(DAY)))


def per_day(detainers: DataFrame) -> DataFrame:
    return freq(detainers, DAY, sort="key")


def per_month(detainers: DataFrame) -> DataFrame:
    return count_by_month(detainers, DAY)


def since(detainers: DataFrame, lo) -> DataFrame:
    """Requests prepared on the day ``lo`` or later."""
    return detainers.where(in_period(F.col(DAY), lo, closed="left"))


def on_day(detainers: DataFrame, day) -> DataFrame:
    return detainers.where(in_period(F.col(DAY), day, day, "both"))


def by_reason(detainers: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Requests per facility and lift reason, wide, with totals; reasons not kept are counted as ``other``."""
    return pivot_with_total(detainers, SITE, REASON, keep)


def extract(detainers: DataFrame, site: str, reason: str) -> DataFrame:
    """The requests of one facility with one lift reason, all columns."""
    return detainers.where((F.col(SITE) == site) & (F.col(REASON) == reason))


def of_type(detainers: DataFrame, prefix: str) -> DataFrame:
    return detainers.where(F.col("detainer_type").startswith(prefix))

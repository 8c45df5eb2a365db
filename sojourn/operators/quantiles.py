"""Exact order statistics, summaries, histograms and duration profiles.

Rows are first counted by group and value, which happens before the shuffle. The counts are sorted over
all groups and written, so that a group of any size is spread over many parts, and a running sum over
them finds the ranks. One algorithm serves all sizes, and the input is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.nulls import join_null_safe
from sojourn.operators.counts import n_people_by
from sojourn.operators.topk import with_running_sum


def _ranked(df: DataFrame, value: str, keys: list[str], weight: str | None) -> DataFrame:
    """``(keys, v, n, upto, total)``: each value with its number of rows, and the running number of known values.

    NaN is the largest value, as it is for Spark's sort. A null value is a row with nothing added.
    """
    v = F.col(value).cast("double")
    times = F.lit(1) if weight is None else F.col(weight)
    counted = df.groupBy(*keys, v.alias("v")).agg(F.sum(times.cast("long")).alias("n"))
    counted = counted.withColumn("known", F.when(F.col("v").isNull(), 0).otherwise(F.col("n")))
    return with_running_sum(counted, [F.col("v").asc_nulls_last()], "known", keys)


def _picks(probs: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over ranked rows, and the quantiles made from them, interpolated between the nearest ranks."""
    total, picks, out = F.col("total"), [F.max("total").alias("total")], []
    for i, (name, p) in enumerate(probs.items()):
        place = (total - 1) * p
        low = F.floor(place) + 1
        for side, rank in (("a", low), ("b", F.least(low + 1, total))):
            holds = (F.col("upto") - F.col("known") < rank) & (rank <= F.col("upto"))
            picks.append(F.max(F.when(holds, F.col("v"))).alias(f"{side}{i}"))
        a, b, beyond = F.col(f"a{i}"), F.col(f"b{i}"), place - F.floor(place)
        between = F.when(F.abs(b - a) == float("inf"), a * (1 - beyond) + b * beyond).otherwise(a + beyond * (b - a))
        out.append(F.when((a == b) | (beyond == 0), a).otherwise(between).alias(name))
    return picks, out


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Quantiles per group, interpolated linearly between the two nearest ranks; nulls are left out.

    ``probs`` maps output names to probabilities. ``weight`` is a whole number of times a row counts.
    """
    keys = list(keys)
    picks, out = _picks(probs)
    ranked = _ranked(df.where(F.col(value).isNotNull()), value, keys, weight)
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *out)


# The six numbers of a summary that are quantiles.
SIX = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def _mean() -> Column:
    return F.sum(F.col("v") * F.col("known")) / F.sum("known")


def summary(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of nulls of a column, in one row."""
    picks, out = _picks(SIX)
    nulls = F.coalesce(F.sum(F.col("n") - F.col("known")), F.lit(0)).alias("n_null")
    found = _ranked(df, value, [], weight).agg(*picks, _mean().alias("mean"), nulls)
    return found.select(*out, "mean", "n_null").select("min", "q1", "median", "mean", "q3", "max", "n_null")


def duration_profile(
    df: DataFrame, key: str, duration: str, on: str, weight: str | None = None, unit: str = "days"
) -> DataFrame:
    """Mean, median and longest duration per place, its stints and its distinct people (null counts once).

    Everything but the people comes from the counts by place and duration; people are first reduced to one
    row per place and person. So neither a hot place nor a hot person reaches one task whole.
    """
    picks, out = _picks({f"median_stint_{unit}": 0.5})
    found = _ranked(df, duration, [key], weight).groupBy(key).agg(
        *picks,
        _mean().alias(f"avg_stint_{unit}"),
        F.max("v").alias(f"max_stint_{unit}"),
        F.sum("n").alias("n_stints"),
    )
    durations = found.select(key, f"avg_stint_{unit}", *out, f"max_stint_{unit}", "n_stints")
    return join_null_safe(durations, n_people_by(df, [key], on), [key])


def pretty_width(lo: Column, hi: Column, cells: int) -> Column:
    """A bin width of 1, 2, 5 or 10 times a power of ten that cuts ``[lo, hi]`` into about ``cells`` bins.

    Equal ends give a width that is round for the value itself, or 1 at 0, so that one bin holds it.
    """
    span = F.when(hi > lo, hi - lo).when(hi != 0, F.abs(hi)).otherwise(F.lit(float(cells)))
    raw = span / F.lit(float(cells))
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    ratio = raw / base
    # The ratios at which the next of 2, 5 and 10 lies nearer, for biases 1.5 and 2.75
    step = F.when(ratio <= 1.4, 1.0).when(ratio <= 2.8, 2.0).when(ratio <= 7.0, 5.0).otherwise(10.0)
    return base * step


def histogram(
    df: DataFrame, value: str, width: float | None = None, breaks: int | None = None, weight: str | None = None
) -> DataFrame:
    """Rows per bin of a fixed width, bins closed on the right and the lowest one on both sides.

    Give the width, or an approximate number of ``breaks`` to choose a round width from the range.
    ``weight`` is the number of times a row counts.
    """
    if (width is None) == (breaks is None):
        raise ValueError("give either width or breaks")
    v = F.col(value).cast("double")
    times = F.lit(1) if weight is None else F.col(weight)
    known = df.where(v.isNotNull()).select(v.alias("v"), times.cast("long").alias("n"))
    if width is not None:
        size = F.lit(float(width))
        lowest = known.agg(F.min("v").alias("lo")).scalar()
    else:
        ends = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        ends = ends.select(F.struct("lo", pretty_width(F.col("lo"), F.col("hi"), breaks).alias("size"))).scalar()
        lowest, size = ends["lo"], ends["size"]
    first = F.floor(lowest / size)
    bin_no = F.greatest(F.ceil(F.col("v") / size) - 1, first)
    bin_from, bin_to = F.col("bin") * F.col("size"), (F.col("bin") + 1) * F.col("size")
    counted = known.select(bin_no.alias("bin"), size.alias("size"), "n").groupBy("bin", "size")
    return counted.agg(F.sum("n").alias("count")).select(bin_from.alias("bin_from"), bin_to.alias("bin_to"), "count")

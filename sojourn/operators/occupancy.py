"""How many episodes overlap each day or week, per place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import bound, day_label


@dataclass(frozen=True)
class Grid:
    """``n`` buckets of ``days`` days each from ``origin`` on."""

    origin: date
    n: int
    days: int = 1

    @property
    def labels(self) -> list[str]:
        starts = [self.origin + timedelta(days=self.days * i) for i in range(self.n)]
        return [self._prefix + d.strftime("%b %d, %Y") for d in starts]

    @property
    def _prefix(self) -> str:
        return "Week of " if self.days == 7 else ""

    def index(self, day: Column) -> Column:
        """Number of the bucket a date lies in; outside the grid too."""
        return F.floor(F.date_diff(day, bound(self.origin)) / F.lit(self.days)).cast("int")

    def start(self, index: Column) -> Column:
        return F.date_add(F.to_date(bound(self.origin)), index * self.days)

    def label(self, index: Column) -> Column:
        return F.concat(F.lit(self._prefix), day_label(self.start(index)))


def weekly(origin: date, n: int) -> Grid:
    return Grid(origin, n, 7)


def daily(origin: date, n: int) -> Grid:
    return Grid(origin, n, 1)


def occupancy(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    grid: Grid,
    open_end: date | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Episodes per place and bucket that share a day with the bucket; both ends of an episode count.

    Long form ``(keys, bucket, bucket_start, n)``, with a row for every bucket of every place. An
    open episode ends at ``open_end``. An episode becomes two changes, +1 in its first bucket and -1
    behind its last, whatever its length; they are summed before the shuffle, and the running sum
    then goes over the buckets of a place, within one row.
    """
    return dense(changes(df, keys, start, end, grid, open_end, weight), keys, grid)


def changes(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    grid: Grid,
    open_end: date | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``(keys, bucket, by)``: by how much the number of episodes changes at a bucket; the first step of occupancy.

    A place without an episode in the grid has one row with a change by 0.
    """
    keys = list(keys)
    first = F.greatest(F.lit(0), grid.index(F.col(start)))
    closing = F.col(end) if open_end is None else F.coalesce(F.col(end), F.to_date(bound(open_end)))
    last = F.least(F.lit(grid.n - 1), grid.index(closing))
    w = F.lit(1) if weight is None else F.col(weight)
    w = w.cast("long")

    def change(bucket: Column, by: Column) -> Column:
        return F.struct(bucket.alias("bucket"), by.alias("by"))

    # greatest/least skip nulls, so a missing start or end has to be ruled out here
    hit = F.col(start).isNotNull() & closing.isNotNull() & (first <= last)
    changes = F.when(hit, F.array(change(first, w), change(last + 1, -w))).otherwise(
        F.array(change(F.lit(0), F.lit(0).cast("long")))
    )
    summed = (
        df.select(*keys, F.explode(changes).alias("c"))
        .groupBy(*keys, F.col("c.bucket").alias("bucket"))
        .agg(F.sum("c.by").alias("by"))
    )
    return summed


def counts_by_place(summed: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """``(keys, counts)``: running sums of the :func:`changes`, one array of all buckets per place, made within the row."""
    keys = list(keys)
    again = summed.groupBy(*keys, "bucket").agg(F.sum("by").alias("by"))
    places = again.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "by"))).alias("by"))

    def add(counts: Column, bucket: Column) -> Column:
        here = F.coalesce(F.try_element_at("by", bucket), F.lit(0))
        return F.concat(counts, F.array(F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)) + here))

    buckets = F.sequence(F.lit(0), F.lit(grid.n - 1))
    return places.select(*keys, F.aggregate(buckets, F.array().cast("array<bigint>"), add).alias("counts"))


def wide_counts(counted: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """:func:`counts_by_place` with one column per bucket: no row per bucket is made on the way, and no pivot."""
    cells = [F.get("counts", F.lit(i)).alias(label) for i, label in enumerate(grid.labels)]
    return counted.select(*keys, *cells)


def dense(summed: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Running sums of the :func:`changes` over all buckets of a place, a row per bucket."""
    keys = list(keys)
    rows = counts_by_place(summed, keys, grid).select(*keys, F.posexplode("counts").alias("bucket", "n"))
    return rows.select(*keys, "bucket", grid.start(F.col("bucket")).alias("bucket_start"), "n")


def occupancy_wide(long: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """One column per bucket. The columns are known from the grid, so no job looks for them."""
    names = grid.labels
    named = long.withColumn("__label", grid.label(F.col("bucket")))
    return named.groupBy(*keys).pivot("__label", names).agg(F.sum("n"))

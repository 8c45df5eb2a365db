"""Long to wide."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending, descending, is_in, na_text

OTHER = "other"


def pivot_wide(
    df: DataFrame,
    rows: Sequence[str],
    names: str,
    value: str,
    values: Sequence[str] | None = None,
    fill: float | int | None = None,
) -> DataFrame:
    """One column per name, one value per cell; a missing cell is null, or ``fill``.

    A null name becomes the column ``NA``. Pass ``values`` when the names are known: it saves the job
    that looks for them, which refuses more than ``spark.sql.pivotMaxValues`` names. A name outside
    ``values`` makes the query fail, so that no cell is lost without notice.
    """
    name = na_text(F.col(names))
    if values is not None:
        unlisted = F.raise_error(F.concat(F.lit("no column is listed for the name "), name)).cast("string")
        name = F.when(name.isin(list(values)), name).otherwise(unlisted)
    named = df.withColumn("__name", name)
    grouped = named.groupBy(*rows)
    wide = (grouped.pivot("__name") if values is None else grouped.pivot("__name", list(values))).agg(F.max(value))
    if fill is None:
        return wide
    return wide.na.fill(fill, subset=[c for c in wide.columns if c not in rows])


def row_total(cols: Sequence[str]) -> Column:
    """Sum over the columns of a row, null as 0."""
    return reduce(add, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in cols])


def fold_other(names: str, keep: Sequence[str]) -> Column:
    """The name if it is kept, else ``other``. Null goes by the name ``NA``."""
    name = na_text(F.col(names))
    return F.when(is_in(name, keep), name).otherwise(OTHER)


def pivot_with_total(
    df: DataFrame,
    row: str,
    names: str,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Count rows per row key and name, wide, with a total, biggest total first.

    With ``keep`` all other names are counted in one column ``other``, 0 where there are none. The
    folding happens before the pivot, so the columns are known and no job looks for them. Without it
    there is a column for every name in the data. Totals come from the counts before the pivot.
    """
    name = na_text(F.col(names)) if keep is None else fold_other(names, keep)
    counted = df.groupBy(row, name.alias("__name")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))  # one row per name, so no window is large
    counted = counted.withColumn("total", total)
    grouped = counted.groupBy(row, "total")
    wide = (grouped.pivot("__name") if keep is None else grouped.pivot("__name", [*keep, OTHER])).agg(F.max("n"))
    if keep is not None:
        wide = wide.na.fill(0, subset=[OTHER]).select(row, *keep, "total", OTHER)
    else:
        wide = wide.select(row, *[f"`{c}`" for c in wide.columns if c not in (row, "total")], "total")
    return wide.orderBy(*descending("total"), *ascending(row))

"""Merges and lookups.

No side carries a broadcast hint: Catalyst broadcasts a side whose files are small enough, AQE one
that turned out small after its shuffle, and a hot key of a sort-merge join is split at run time.
Callers aggregate before a lookup wherever the lookup is not part of the group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.nulls import join_null_safe


def merge_inner(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    suffixes: tuple[str, str] = (".x", ".y"),
    null_keys: bool = True,
) -> DataFrame:
    """Inner join on shared key columns; other shared column names get a suffix on each side.

    Null keys match null keys unless ``null_keys`` is false.
    """
    keys = [on] if isinstance(on, str) else list(on)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return join_null_safe(left, right, keys) if null_keys else left.join(right, keys)


def person_weights(df: DataFrame, on: str | Sequence[str], weight: str = "weight") -> DataFrame:
    """One row per key with its number of rows.

    Merging with this instead of with the rows themselves carries the same information for every
    count, sum and quantile over the merge, and never writes out the pairs of a key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return df.groupBy(*keys).agg(F.count("*").alias(weight))


def lookup(df: DataFrame, dim: DataFrame, on: str, suffixes: tuple[str, str] = (".x", ".facility")) -> DataFrame:
    """Inner join to a crosswalk; rows whose code it lacks drop out. Null codes never match."""
    return merge_inner(df, dim.where(F.col(on).isNotNull()), on, suffixes, null_keys=False)


def crosswalk(dim: DataFrame, code: str, name: str) -> DataFrame:
    """One row ``(code, name)`` per code of a table."""
    known = dim.where(F.col(code).isNotNull())
    return known.groupBy(F.col(code).alias("code")).agg(F.min(name).alias("name"))


def label_codes(df: DataFrame, names: DataFrame, col: Column | str, out: str) -> DataFrame:
    """Add ``out``: the name a :func:`crosswalk` has for the code in ``col``, or the code itself if it has none."""
    coded = df.withColumn("__code", F.col(col) if isinstance(col, str) else col)
    names = names.select(F.col("code").alias("__of"), F.col("name").alias("__name"))
    found = coded.join(names, coded["__code"].eqNullSafe(names["__of"]), "left")
    return found.withColumn(out, F.coalesce("__name", "__code")).drop("__of", "__name", "__code")

"""Scans. All of them are lazy: a filter or a projection put on the result reaches the files."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sojourn.functions.dates import in_period
from sojourn.functions.nulls import NA


def scan(
    spark: SparkSession, path: str, where: Column | str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """Parquet table, with the filter in the scan. A known schema saves the job that reads it from a file."""
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return df if where is None else df.where(where)


#: Lengths of the periods of a dated layout.
UNITS = ("day", "month", "year")


def part_name(day: str, unit: str) -> str:
    """The partition column of a dated layout."""
    return f"{day}_{unit}"


def scan_period(
    spark: SparkSession, path: str, day: str, lo=None, hi=None, closed: str = "neither", unit: str = "month"
) -> DataFrame:
    """The rows of a period (:func:`in_period`) from a table that ``sink_dated`` wrote; other months are not listed.

    The folders to read follow from the bounds; the bounds themselves then choose the rows, as they would of any table.
    """
    table = spark.read.parquet(path)
    part = part_name(day, unit)
    for bound, test in ((lo, F.col(part).__ge__), (hi, F.col(part).__le__)):
        if bound is not None:
            table = table.where(test(F.lit(_begin(bound, unit))))
    return table.where(in_period(F.col(day), lo, hi, closed)).drop(part)


def _begin(value: date | datetime | str, unit: str) -> date:
    """First day of the period that a bound lies in."""
    value = datetime.fromisoformat(str(value))
    return date(value.year, 1 if unit == "year" else value.month, value.day if unit == "day" else 1)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV table with a header. The schema is declared: inferring it would read the files twice."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=NA, enforceSchema=False)


def register(df: DataFrame, name: str) -> DataFrame:
    """Name a query, so that SQL and ``spark.table(name)`` can use it; nothing runs."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def file_info(df: DataFrame) -> DataFrame:
    """One row per file of a file-based table: its size and its number of rows."""
    return df.groupBy(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size")
    ).agg(F.count("*").alias("n_rows"))

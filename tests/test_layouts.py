"""Tables laid out by day, lists of ids as tables, and wide occupancy without a pivot: rows and plans."""

import contextlib
import io
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sojourn.functions.dates import in_period
from sojourn.operators.cohort import restrict_to_ids
from sojourn.operators.occupancy import changes, counts_by_place, daily, occupancy, occupancy_wide, wide_counts
from sojourn.plans import queries_analyses, queries_operators  # noqa: F401  (fill the registry)
from sojourn.plans.registry import QUERIES
from sojourn.session import release
from sojourn.sources.sinks import sink_dated
from sojourn.sources.tables import scan_period


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def visits(spark):
    moments = [datetime(2025, 11, 30, 23, 59), datetime(2025, 12, 1), datetime(2025, 12, 1, 8), datetime(2025, 12, 31, 23)]
    moments += [datetime(2026, 1, 1), datetime(2026, 2, 14, 5), None, datetime(2026, 2, 14)] * 3
    return spark.createDataFrame(list(enumerate(moments)), "id int, at timestamp_ntz").withColumn("day", F.to_date("at"))


BOUNDS = ("2025-12-01", "2025-12-01 00:00:00", date(2025, 12, 31), datetime(2026, 2, 14), "2026-02-14 00:00:00", None)


@pytest.mark.parametrize("unit", ["day", "month", "year"])
@pytest.mark.parametrize("column", ["at", "day"])
def test_dated_layout_gives_the_same_rows(spark, visits, tmp_path, unit, column):
    path = str(tmp_path / "t")
    sink_dated(visits, path, column, unit)
    for lo in BOUNDS[:3]:
        for hi in BOUNDS[2:]:
            for closed in ("neither", "both"):
                found = scan_period(spark, path, column, lo, hi, closed, unit)
                want = visits.where(in_period(F.col(column), lo, hi, closed))
                assert found.columns == visits.columns
                assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())), (lo, hi, closed)


def test_dated_layout_reads_only_its_months(spark, sf_dir):
    df = QUERIES["dated_period"](spark, sf_dir)
    text = plan(df)
    assert "PartitionFilters: [isnotnull(o_orderdate_month" in text and "PushedFilters: [IsNotNull(o_orderdate)" in text
    assert len({f.split("o_orderdate_month=")[1].split("/")[0] for f in df.inputFiles()}) > 60  # all are there
    read = df.select(F.input_file_name().alias("f")).distinct().collect()
    assert {f["f"].split("o_orderdate_month=")[1][:7] for f in read} <= {
        f"{y}-{m:02}" for y in (1996, 1997, 1998) for m in range(1, 13)
    }
    release(spark)


def test_a_million_ids_are_no_part_of_the_plan(spark):
    df = spark.range(3_000_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"))
    found = restrict_to_ids(df, "id", [*range(0, 2_000_000, 2), None, 4, 4])
    short = restrict_to_ids(df, "id", [1])
    missing = 3_000_000 - sum(1 for _ in range(3_000_000) if _ % 7)
    assert found.count() == sum(1 for i in range(0, 2_000_000, 2) if i % 7) + missing
    assert len(plan(found)) < 2 * len(plan(short)) and found.where("id IS NULL").count() == missing
    release(spark)


def test_wide_counts_need_no_row_per_bucket(spark):
    origin = date(2026, 1, 1)
    rows = [("A", date(2025, 12, 20), date(2026, 1, 3)), ("A", date(2026, 1, 3), None), (None, date(2026, 1, 2), date(2026, 1, 2))]
    df = spark.createDataFrame([*rows, ("B", None, None)], "place string, s date, e date")
    grid = daily(origin, 6)
    wide = wide_counts(counts_by_place(changes(df, ["place"], "s", "e", grid, date(2026, 1, 5)), ["place"], grid), ["place"], grid)
    pivoted = occupancy_wide(occupancy(df, ["place"], "s", "e", grid, date(2026, 1, 5)), ["place"], grid)
    assert wide.columns == pivoted.columns
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, pivoted.collect()))
    after = plan(wide).split("== Physical Plan ==")[1].split("Scan")[0]
    assert "Window" not in after and after.count("Generate") == 1  # the changes' own

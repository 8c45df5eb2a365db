from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sojourn.operators.occupancy import daily, occupancy, occupancy_wide, weekly

ORIGIN = date(2025, 12, 1)
SCHEMA = "place string, s date, e date, w int"


def day(n):
    return ORIGIN + timedelta(days=n)


def brute(rows, grid, open_end):
    out = {}
    for place in {r[0] for r in rows}:
        for b in range(grid.n):
            lo, hi = day(b * grid.days), day(b * grid.days + grid.days - 1)
            ends = [(s, e or open_end, w) for p, s, e, w in rows if p == place]
            out[place, b] = sum(w for s, e, w in ends if s is not None and e is not None and lo <= e and hi >= s)
    return out


offsets = st.one_of(st.none(), st.integers(-20, 40))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from(["A", "B", None]), offsets, offsets, st.integers(1, 3)), min_size=1, max_size=30),
    days=st.sampled_from([1, 7]),
    open_end=st.sampled_from([None, 25]),
)
def test_equals_the_overlap_rule(spark, rows, days, open_end):
    """Open, reversed, clipped and missing intervals included."""
    rows = [(p, None if s is None else day(s), None if e is None else day(e), w) for p, s, e, w in rows]
    grid = daily(ORIGIN, 20) if days == 1 else weekly(ORIGIN, 3)
    end = None if open_end is None else day(open_end)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["place"], r["bucket"]): r["n"] for r in occupancy(df, ["place"], "s", "e", grid, end, "w").collect()}
    assert found == brute(rows, grid, end)


def test_reversed_interval_counts_only_inside_one_bucket(spark):
    df = spark.createDataFrame([("A", day(3), day(1), 1)], SCHEMA)
    assert [r["n"] for r in occupancy(df, ["place"], "s", "e", weekly(ORIGIN, 2)).orderBy("bucket").collect()] == [1, 0]
    assert sum(r["n"] for r in occupancy(df, ["place"], "s", "e", daily(ORIGIN, 9)).collect()) == 0


def test_wide_has_a_column_per_bucket_and_keeps_empty_places(spark):
    grid = weekly(ORIGIN, 14)
    assert (grid.labels[0], grid.labels[-1]) == ("Week of Dec 01, 2025", "Week of Mar 02, 2026")
    assert (daily(ORIGIN, 91).labels[0], daily(ORIGIN, 91).labels[-1]) == ("Dec 01, 2025", "Mar 01, 2026")
    df = spark.createDataFrame([("A", day(8), day(8), 1), ("B", day(-9), day(-5), 1)], SCHEMA)
    wide = occupancy_wide(occupancy(df, ["place"], "s", "e", grid), ["place"], grid)
    assert wide.columns == ["place", *grid.labels]
    rows = {r["place"]: tuple(r)[1:] for r in wide.collect()}
    assert rows == {"A": (0, 1) + (0,) * 12, "B": (0,) * 14}


@pytest.mark.parametrize("grid", [daily(ORIGIN, 1), weekly(ORIGIN, 1)])
def test_single_bucket(spark, grid):
    df = spark.createDataFrame([("A", day(-100), day(100), 1)], SCHEMA)
    assert [r["n"] for r in occupancy(df, ["place"], "s", "e", grid).collect()] == [1]

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.nulls import holds, is_in, join_null_safe, na_text
from sojourn.functions.text import close_path, passes_through, split_path, title_case


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("CHINA, PEOPLES REPUBLIC OF", "China, Peoples Republic of"),
        ("DEM REP OF THE CONGO", "Dem Rep of the Congo"),
        ("BOSNIA-HERZEGOVINA", "Bosnia-Herzegovina"),
        ("ST. LUCIA", "St. Lucia"),
        ("THE GAMBIA", "The Gambia"),
        ("ISLE OF MAN (UNDER UK)", "Isle of Man (under Uk)"),
        ("TURKIYE", "Turkiye"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, raw, shown):
    assert one(spark, raw, title_case) == shown


@pytest.mark.parametrize(
    ("path", "places"),
    [("A; B; ", ["A", "B"]), ("A; B", ["A", "B"]), ("A", ["A"]), ("A; ; B; ", ["A", "", "B"]), ("", []), (None, None)],
)
def test_split_path(spark, path, places):
    assert one(spark, path, split_path) == places


def test_paths_close_and_contain(spark):
    assert one(spark, "A; B", close_path) == "A; B; "
    assert one(spark, None, close_path) is None
    assert one(spark, "A; HOLD; B", lambda c: passes_through(c, "HOLD")) is True


def test_null_is_no_member_also_under_negation(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows.where(is_in(F.col("x"), ["a"])).count() == 1
    assert rows.where(~is_in(F.col("x"), ["a"])).count() == 2
    assert rows.where(holds(F.col("x") == "a") | F.lit(False)).count() == 1
    assert sorted(r[0] for r in rows.select(na_text(F.col("x"))).collect()) == ["NA", "a", "b"]


def test_null_keys_match_null_keys(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2")], "k int, l string")
    right = spark.createDataFrame([(1, "r1"), (None, "r2")], "k int, r string")
    found = {tuple(r) for r in join_null_safe(left, right, ["k"]).collect()}
    assert found == {(1, "l1", "r1"), (None, "l2", "r2")}
    assert join_null_safe(left, right, ["k"], "left_anti").count() == 0


def test_periods(spark):
    at = [datetime(2025, 12, 1), datetime(2025, 12, 1, 0, 0, 1), datetime(2025, 12, 2), datetime(2025, 12, 3)]
    rows = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")

    def kept(*args, col=F.col("t"), **kw):
        return rows.where(dates.in_period(col, *args, **kw)).count()

    assert kept("2025-12-01 00:00:00") == 3
    assert kept("2025-12-01", col=dates.as_date(F.col("t"))) == 2
    assert kept("2025-12-01", closed="left", col=dates.as_date(F.col("t"))) == 4
    assert kept(date(2025, 12, 1), date(2025, 12, 3)) == 2
    assert kept(datetime(2025, 12, 1), datetime(2025, 12, 3), "right") == 3
    assert kept(datetime(2025, 12, 1), datetime(2025, 12, 3), "both") == 4
    assert kept(hi="2025-12-02") == 2
    with pytest.raises(ValueError):
        dates.in_period(F.col("t"))
    with pytest.raises(ValueError):
        dates.in_period(F.col("t"), 1, 2, "open")


def test_dates(spark):
    assert one(spark, "2026-02-11", dates.parse_ymd) == date(2026, 2, 11)
    assert one(spark, "11.2.2026", dates.parse_ymd) is None
    assert one(spark, "2026-02-11 10:30:00", dates.as_datetime) == datetime(2026, 2, 11, 10, 30)
    assert one(spark, "soon", dates.as_datetime) is None
    assert one(spark, date(2026, 2, 1), dates.month_key, "date") == "2026-02"
    assert one(spark, date(2026, 2, 1), dates.day_label, "date") == "Feb 01, 2026"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_durations(spark, kind):
    rows = spark.createDataFrame([(datetime(2026, 1, 1, 12), datetime(2026, 1, 3, 11, 59, 59, 500000))], f"a {kind}, b {kind}")
    a, b = F.col("a"), F.col("b")
    hours, days, whole, back = rows.select(
        dates.hours_between(a, b), dates.days_between(a, b), dates.whole_days_between(a, b), dates.whole_days_between(b, a)
    ).first()
    assert hours == pytest.approx(48 - 0.5 / 3600)
    assert days == pytest.approx(hours / 24)
    assert (whole, back) == (1, -2)

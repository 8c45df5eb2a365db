import os
import subprocess
import sys
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending
from sojourn.operators.classify import UNMATCHED, classify, outcome, terminal, unmatched
from sojourn.operators.cohort import drop_flagged, only_in, repeated, restrict_to, restrict_to_ids
from sojourn.operators.counts import freq, n_people, n_people_by, null_count, share, table_of
from sojourn.operators.dedupe import collapse_episodes, dedupe_first, history, latest
from sojourn.operators.joins import crosswalk, label_codes, lookup, merge_inner
from sojourn.operators.pivot import pivot_wide, pivot_with_total
from sojourn.operators.rolling import densify, rolling_mean_centered
from sojourn.operators.topk import top_n_with_ties
from sojourn.plans import arrests, custody
from sojourn.session import release, scratch_path, shared_dir, stored, write_once
from sojourn.sources.sinks import sink_csv
from sojourn.sources.tables import file_info, register, scan, scan_csv


def rows(df):
    return [tuple(r) for r in df.collect()]


# Cohorts and joins


def test_flags(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, flag boolean")
    assert rows(drop_flagged(df, "flag")) == [(2, False)]


def test_restrict_and_difference_take_null_as_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, x string")
    cohort = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert sorted(r[1] for r in rows(restrict_to(df, cohort, "id"))) == ["a", "b", "d"]
    assert rows(only_in(df, cohort, "id")) == [(2,)]
    assert rows(repeated(df, "id")) == [(1, 2)]
    for more in ([], list(range(10, 3000))):  # a list of any length gives the same rows
        assert sorted(r[1] for r in rows(restrict_to_ids(df, "id", [1, *more]))) == ["a", "b"]
        assert sorted(r[1] for r in rows(restrict_to_ids(df, "id", [1, None, *more]))) == ["a", "b", "d"]
    assert rows(restrict_to_ids(df, "id", [])) == [] and rows(restrict_to_ids(df, "id", [None])) == [(None, "d")]


def test_merge_suffixes_and_null_keys(spark):
    left = spark.createDataFrame([(1, 10, "l"), (None, 20, "l")], "id int, n int, only_left string")
    right = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "id int, n int")
    merged = merge_inner(left, right, "id")
    assert merged.columns == ["id", "n.x", "only_left", "n.y"]
    assert sorted(rows(merged), key=repr) == [(1, 10, "l", 5), (1, 10, "l", 6), (None, 20, "l", 7)]
    assert merge_inner(left, right, "id", null_keys=False).count() == 2


def test_lookup_drops_and_label_keeps_unknown_codes(spark):
    df = spark.createDataFrame([("A", "s"), ("Z", "s"), (None, "s")], "code string, state string")
    dim = spark.createDataFrame([("A", "Place A", "MN"), (None, "nowhere", "XX")], "code string, name string, state string")
    assert rows(lookup(df, dim, "code")) == [("A", "s", "Place A", "MN")]
    assert lookup(df, dim, "code").columns == ["code", "state.x", "name", "state.facility"]
    labelled = label_codes(df, crosswalk(dim, "code", "name"), "code", "label")
    assert sorted(((r["code"], r["label"]) for r in labelled.collect()), key=repr) == [
        ("A", "Place A"), ("Z", "Z"), (None, None)
    ]


def test_merge_size_without_pairs(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "unique_identifier string")
    right = spark.createDataFrame([("a",), ("a",), ("a",), ("c",), (None,)], "unique_identifier string")
    merged = merge_inner(left, right, "unique_identifier")
    assert rows(custody.merged_rows(left, right)) == [(merged.count(), 2)]


# Counts


def test_freq_order_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("c",)], "k string")
    assert rows(freq(df, "k")) == [("c", 2), ("a", 1), ("b", 1), (None, 1)]
    assert rows(freq(df, "k", sort="key")) == [("a", 1), ("b", 1), ("c", 2), (None, 1)]
    assert rows(freq(df, "k", n=2)) == [("c", 2), ("a", 1)]
    assert rows(table_of(df, "k")) == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(n_people(df, "k")) == [(4,)]
    assert rows(n_people_by(df.withColumn("g", F.lit(1)), ["g"], "k")) == [(1, 4)]
    assert rows(df.agg(share(F.col("k") == "c"), null_count(F.col("k")))) == [(0.5, 1)]


def test_top_with_ties(spark):
    df = spark.createDataFrame([(chr(97 + i), 20 - i if i < 9 else 5) for i in range(11)] + [("z", 1), ("n", None)], "k string, count int")
    assert top_n_with_ties(df, "count", 10).count() == 11
    assert top_n_with_ties(df, "count", 100).count() == 12


# Deduplication


def test_first_and_latest(spark):
    df = spark.createDataFrame(
        [("p", datetime(2026, 1, 2), 1), ("p", datetime(2026, 1, 2), 2), ("p", datetime(2026, 1, 1), 3), ("q", None, 4),
         ("q", datetime(2026, 1, 9), 5)],
        "id string, t timestamp_ntz, n int",
    )
    assert sorted(r[2] for r in rows(dedupe_first(df, ["id", "t"], ascending("n")))) == [1, 3, 4, 5]
    assert sorted(r[2] for r in rows(latest(df, "id", "t", ["n"]))) == [2, 4]
    stays = df.toDF("unique_identifier", "stay_book_in_date_time", "n")
    # same-time duplicates first, then the last stay
    two_steps = latest(dedupe_first(stays, stays.columns[:2], ascending("n")), stays.columns[0], stays.columns[1], ["n"])
    assert sorted(rows(custody.latest_stays(stays, ["n"])), key=repr) == sorted(rows(two_steps), key=repr)


@pytest.mark.parametrize("n", [8, 3000])
def test_history_and_collapse_have_one_shape_at_every_size(spark, n):
    data = [("p", date(2026, 1, 1) + timedelta(i), f"{i}; ", 2, i) for i in range(n)]
    data += [("q", date(2026, 2, 1), "x; ", 1, 0), ("q", None, "y; ", 1, 1), (None, None, "z; ", 1, 1)]
    df = spark.createDataFrame(data, "id string, t date, path string, n int, k int").repartition(4)
    pieces = {}
    for r in history(df, "id", "t", "path", ["k"]).orderBy("position").collect():
        pieces.setdefault(r["id"], []).append((r["position"], r["path"]))
    assert pieces["p"] == [(i + 1, f"{i}; ") for i in range(n)]
    assert pieces["q"] == [(1, "x; "), (2, "y; ")] and pieces[None] == [(1, "z; ")]
    found = {r["id"]: tuple(r)[1:] for r in collapse_episodes(df, "id", "t", "n").collect()}
    assert found == {"p": (date(2026, 1, 1), 2 * n, n), "q": (date(2026, 2, 1), 2, 2), None: (None, 1, 1)}


def test_first_arrest_has_a_time(spark):
    t = datetime(2026, 1, 5)
    arrests = spark.createDataFrame(
        [("p", None, "none"), ("p", t, "first"), ("p", t + timedelta(1), "later"), ("q", None, "only")],
        "unique_identifier string, apprehension_date_time timestamp_ntz, apprehension_criminality string",
    )
    stays = spark.createDataFrame([("p",), ("q",)], "unique_identifier string")
    assert sorted(rows(custody.arrested_stays(stays, arrests))) == [("p", 3, "first"), ("q", 1, "only")]


# Classification


def test_outcome_rules_in_order(spark):
    cases = [
        ("Removed", None, "Deported from country"), ("Removed", "X", "Deported from country"),
        ("Voluntary departure", "X", "Voluntary departure"), ("Died", "X", "Left country (other)"),
        (None, "X", "Left country (other)"), ("Paroled", None, "Released from detention"),
        (None, None, "Detained as of early March"), ("Withdrawal", None, "Unclear or other outcome"),
        ("Died", None, "Died"), ("Something new", None, UNMATCHED),
    ]
    df = spark.createDataFrame(cases, "reason string, country string, expected string")
    found = df.withColumn("o", outcome(F.col("reason"), F.col("country")))
    assert found.where("o <> expected").count() == 0
    assert unmatched(found, "o").count() == 1
    ends = {tuple(r) for r in df.select("reason", "country", terminal(F.col("reason"), F.col("country"))).collect()}
    assert ("Removed", None, "No country listed") in ends and ("Died", None, None) in ends
    assert rows(df.select(classify([(F.col("reason") == "Died", "d")]).alias("c")).distinct().orderBy("c")) == [(None,), ("d",)]


# Rolling means and pivots


def test_rolling_mean_has_full_frames_only(spark):
    data = [("a", date(2026, 1, 1 + i), i) for i in range(10)] + [("b", date(2026, 1, 1 + i), 9) for i in range(4)]
    df = spark.createDataFrame(data, "k string, d date, n int")
    found = rolling_mean_centered(df, ["k"], "d", "n").orderBy("k", "d").collect()
    assert [r["rolling_avg"] for r in found] == [0, 0, 0, 3, 4, 5, 6, 0, 0, 0] + [0] * 4
    with pytest.raises(ValueError):
        rolling_mean_centered(df, ["k"], "d", "n", k=6)


def test_rolling_counts_rows_not_days(spark):
    df = spark.createDataFrame([("a", date(2026, 1, 1 + 3 * i), i) for i in range(7)], "k string, d date, n int")
    assert sorted(r["rolling_avg"] for r in rolling_mean_centered(df, ["k"], "d", "n").collect()) == [0] * 6 + [3]


def test_pivot_names_nulls(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, None, 6), (2, "a", 7)], "r int, k string, n int")
    wide = pivot_wide(df, ["r"], "k", "n")
    assert wide.columns == ["r", "NA", "a"]
    assert sorted(rows(wide)) == [(1, 6, 5), (2, None, 7)]
    assert sorted(rows(pivot_wide(df, ["r"], "k", "n", ["a", "NA"], fill=0))) == [(1, 5, 6), (2, 7, 0)]


def test_pivot_with_total_and_other(spark):
    df = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", None), ("t", "c"), ("u", "b"), ("u", "c")], "site string, why string")
    assert rows(pivot_with_total(df, "site", "why", keep=["a", "NA"])) == [
        ("s", 1, 1, 3, 1), ("u", None, None, 2, 2), ("t", None, None, 1, 1)
    ]
    assert pivot_with_total(df, "site", "why").columns == ["site", "NA", "a", "b", "c", "total"]


def test_types_by_period(spark):
    df = spark.createDataFrame(
        [("C", date(2025, 11, 30)), ("T", date(2025, 12, 1)), ("T", date(2025, 12, 2)), (None, date(2025, 12, 20))],
        "apprehension_type string, apprehension_date date",
    )
    periods = {"before": (None, "2025-12-01", "neither"), "after": ("2025-12-01", None, "neither")}
    found = {tuple(r) for r in arrests.type_by_period(df, periods).collect()}
    assert found == {("before", "C", 1, 100.0), ("after", "T", 1, 50.0), ("after", None, 1, 50.0)}


# Sources and sinks


def test_csv_round_trip_with_index(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, date(2026, 1, 1)), ("a", 2, None), (None, 9, None)], "k string, n long, d date")
    path = str(tmp_path / "out.csv")
    sink_csv(df, path, index=[F.col("n").desc(), *ascending("k")])
    back = scan_csv(spark, path, "row_index long, k string, n long, d date").orderBy("row_index")
    assert rows(back) == [(1, None, 9, None), (2, "a", 2, None), (3, "b", 2, date(2026, 1, 1))]
    text = "".join(p.read_text() for p in (tmp_path / "out.csv").glob("part-*"))
    assert "row_index,k,n,d" in text and "1,NA,9,NA" in text
    with pytest.raises(Exception, match="(?i)exist"):
        sink_csv(df, path)


def test_scan_register_and_file_info(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).repartition(4).write.parquet(path)
    view = register(scan(spark, path, "id >= 90"), "late_rows")
    assert view.count() == 10 and spark.sql("SELECT max(id) FROM late_rows").first()[0] == 99
    info = file_info(scan(spark, path)).collect()
    assert len(info) == 4 and sum(r["n_rows"] for r in info) == 100 and all(r["file_size"] > 0 for r in info)


def test_shared_dir_is_the_session_setting(tmp_path):
    """Tables go to the folder the cluster names. Needs a session of its own."""
    script = f"""
from pyspark.sql import SparkSession
from sojourn.session import shared_dir, write_once
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate())
assert write_once(spark.range(5)).count() == 5
assert shared_dir(spark) == "{tmp_path}/shared"
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert list((tmp_path / "shared").rglob("part-*"))


def test_written_tables_are_removed(spark):
    folder = shared_dir(spark)
    release(spark)
    before = set(os.listdir(folder))
    with stored(spark.range(3)) as table:
        assert table.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
    write_once(spark.range(3))
    spark.range(3).write.csv(scratch_path(spark, ".csv"))
    assert len(set(os.listdir(folder)) - before) == 2
    release(spark)
    assert set(os.listdir(folder)) == before


def test_unlisted_names_are_counted_or_refused(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "new"), ("y", None)], "site string, why string")
    found = {r["site"]: r.asDict() for r in pivot_with_total(df, "site", "why").collect()}
    assert found["y"] == {"site": "y", "NA": 1, "a": None, "b": None, "new": 1, "total": 2}
    kept = {r["site"]: tuple(r) for r in pivot_with_total(df, "site", "why", keep=["a"]).collect()}
    assert kept == {"x": ("x", 1, 2, 1), "y": ("y", None, 2, 2)}
    counted = df.groupBy("site", "why").count()
    with pytest.raises(Exception, match="no column is listed for the name new"):
        pivot_wide(counted, ["site"], "why", "count", ["a", "b", "NA"]).collect()


def test_densify_fills_missing_days(spark):
    day = lambda d: date(2026, 1, d)
    data = [("a", day(1), 5), ("a", day(4), 7), (None, day(2), 1), ("a", None, 9)]
    df = spark.createDataFrame(data, "k string, day date, n int")
    found = sorted(rows(densify(df, ["k"], "day", "n")), key=repr)
    expected = [("a", day(1), 5), ("a", day(2), 0), ("a", day(3), 0), ("a", day(4), 7), (None, day(2), 1)]
    assert found == sorted(expected, key=repr)

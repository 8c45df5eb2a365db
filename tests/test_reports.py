"""All analyses on a small invented case."""

from datetime import date, datetime

import pytest

from sojourn.plans.reports import Inputs, Scope, build, write


@pytest.fixture(scope="module")
def inputs(spark):
    t = datetime
    arrests = spark.createDataFrame(
        [
            ("p1", date(2025, 12, 3), t(2025, 12, 3, 9), "MINNESOTA", "Targeted", "MEXICO", False),
            ("p1", date(2026, 1, 3), t(2026, 1, 3, 9), "MINNESOTA", "Collateral", "MEXICO", False),
            ("p2", date(2025, 12, 9), t(2025, 12, 9, 9), "MINNESOTA", "Targeted", "DEM REP OF THE CONGO", False),
            ("p3", date(2025, 12, 9), t(2025, 12, 9, 9), "MINNESOTA", None, None, None),
            ("p4", date(2025, 12, 1), t(2025, 12, 1, 9), "MINNESOTA", "Targeted", "PERU", False),
            ("p5", date(2025, 12, 8), t(2025, 12, 8, 9), "TEXAS", "Targeted", "PERU", False),
        ],
        "unique_identifier string, apprehension_date date, apprehension_date_time timestamp_ntz, apprehension_state string,"
        "apprehension_type string, citizenship_country string, duplicate_likely boolean",
    ).selectExpr("*", "'x' AS case_status", "'y' AS apprehension_criminality")
    hold, area = "SPMHOLD", "St. Paul Area of Responsibility"
    stays = spark.createDataFrame(
        [
            ("p1", t(2025, 12, 3, 12), t(2025, 12, 5, 11), 2, f"{hold}; CAMP", "elsewhere", "Transferred", None),
            ("p1", t(2026, 1, 3, 12), t(2026, 1, 13, 13), 2, f"{hold}; CAMP", "elsewhere", "Removed", "MEXICO"),
            ("p2", t(2025, 12, 9, 12), None, 1, "JAIL", area, None, None),
            ("p4", t(2025, 12, 1, 12), t(2025, 12, 2), 1, hold, area, "Paroled", None),
            ("p4", t(2025, 11, 1, 12), t(2025, 11, 2), 1, hold, area, "Paroled", None),
            ("p6", t(2025, 12, 20), None, 1, hold, area, None, None),
            ("p7", t(2025, 12, 20), None, 1, "FAR", "elsewhere", None, None),
            ("p8", t(2025, 12, 20), None, 1, "JAIL", area, None, None),  # booked in by the area, never at the facility
        ],
        "unique_identifier string, stay_book_in_date_time timestamp_ntz, stay_book_out_date_time timestamp_ntz, n_stints int,"
        "detention_facility_codes_all string, book_in_aor string, stay_release_reason string, departure_country string",
    )
    stints = spark.createDataFrame(
        [
            ("p1", t(2025, 12, 3, 12), hold, "BISHOP HENRY WHIPPLE FED BLDG", t(2025, 12, 3, 12), t(2025, 12, 4), False),
            ("p1", t(2026, 1, 3, 12), "CAMP", "ERO EL PASO CAMP EAST MONTANA", t(2026, 1, 5), t(2026, 1, 13), False),
            ("p1", t(2026, 1, 3, 12), "CAMP", "ERO EL PASO CAMP EAST MONTANA", t(2026, 1, 5), t(2026, 1, 13), True),
            ("p2", t(2025, 12, 9, 12), "JAIL", "JAIL", t(2025, 12, 9, 12), None, False),
        ],
        "unique_identifier string, stay_book_in_date_time timestamp_ntz, detention_facility_code string,"
        "detention_facility string, book_in_date_time timestamp_ntz, book_out_date_time timestamp_ntz, likely_duplicate boolean",
    ).selectExpr("*", "stay_book_in_date_time AS stay_book_out_date_time")
    facilities = spark.createDataFrame(
        [(hold, "Holding Building", "MN", 1.0, 2.0, "a"), ("CAMP", "Camp", "TX", 3.0, 4.0, None), (None, "?", None, None, None, None)],
        "detention_facility_code string, name string, state string, latitude double, longitude double, address string",
    )
    detainers = spark.createDataFrame(
        [
            ("2025-12-01", "ADC", "Booked into Detention", "I247A - x", False),
            ("2025-12-02", "ADC", "Something else", "I247A - x", False),
            ("2025-11-30", "ADC", None, "I247G", False),
            ("2026-01-02", "JAIL", None, "I247G", False),
            ("2026-01-02", "JAIL", None, "I247G", True),
        ],
        "detainer_prepare_date string, detention_facility string, detainer_lift_reason string, detainer_type string, duplicate_likely boolean",
    )
    population = spark.createDataFrame(
        [(date(2026, 1, d), "CAMP", d) for d in range(1, 9)], "date date, detention_facility_code string, n_detained int"
    )
    return Inputs(arrests, stays, stints, facilities, detainers, population)


@pytest.fixture(scope="module")
def reports(inputs):
    return build(inputs, Scope())


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_cohort_and_outcomes(reports):
    # the merge has a row per stay and arrest: p1 has 2 x 2, p2 1 x 1; p4's arrest is not after the first day
    assert rows(reports["arrested_people"]) == {(2,)} and rows(reports["arrested_again"]) == {("p1", 2)}
    assert rows(reports["merged_rows"]) == {(5, 2)}
    assert rows(reports["detention_by_outcome"]) == {("Deported from country", 1), ("Detained as of early March", 1)}
    assert rows(reports["deportation_by_country"]) == {("Mexico", 1)}
    assert rows(reports["length_shares"]) == {(1, 1, 50.0), (2, 1, 50.0)}
    assert rows(reports["length_p90"]) == {(1.9,)} and rows(reports["path_mismatches"]) == {(0, 2)}
    assert rows(reports["held_people"]) == {(1,)} and rows(reports["release_reasons"]) == {("Removed", 1), (None, 1)}
    assert rows(reports["stay_lengths"]) == {(10, 1)}
    assert rows(reports["held_not_arrested"]) == {("p6",)}
    assert rows(reports["prior_release_reasons"]) == {("Paroled", 1)}


def test_flows(reports):
    assert rows(reports["flow_by_length"]) == {
        (1, "JAIL", "Detained as of early March", 1, 2, 1),
        (2, "Holding Building", "Camp", 1, 2, 1),
        (2, "Camp", "Deported from country", 2, 3, 1),
        (2, "Deported from country", "Mexico", 3, 4, 1),
    }
    assert reports["flow_2_simplified"].count() == 3 and reports["flow_3_simplified"].count() == 0


def test_durations_count_a_stint_once_per_arrest(reports):
    assert rows(reports["stint_lengths"]) == {("Holding Building", 0.5, 0.5, 0.5, 2, 1, "MN"), ("Camp", 8.0, 8.0, 8.0, 2, 1, "TX")}
    assert rows(reports["durations_2"]) == {(8.0, 2)}
    assert rows(reports["long_stays_1"]) == {(0.0,)} and rows(reports["long_stays_2"]) == {(1.0,)}
    assert rows(reports["histogram_1"]) == {(0.5, 0.51, 2)}
    assert reports["held_summary"].first()["max"] == 12.0


def test_occupancy(reports):
    week = {r["name"]: r for r in reports["occupancy_week"].collect()}
    assert week["Holding Building"]["Week of Dec 01, 2025"] == 2 and week["Camp"]["Week of Jan 05, 2026"] == 2
    day = {r["name"]: r for r in reports["occupancy_day"].collect()}
    assert [day["Camp"][c] for c in ("Jan 04, 2026", "Jan 05, 2026", "Jan 13, 2026", "Jan 14, 2026")] == [0, 2, 2, 0]


def test_arrests(reports):
    assert rows(reports["arrests_by_country"]) == {("Mexico", 2), ("Dem Rep of the Congo", 1)}
    assert reports["daily_arrests"].columns == ["apprehension_date", "MINNESOTA", "TEXAS"]
    assert {r[1] for r in rows(reports["types_by_day"])} == {0, 1}
    assert ("period", "Collateral", 1) in {r[:3] for r in rows(reports["types_by_period"])}
    assert reports["arrests_after"].count() == 0


def test_requests_and_population(reports):
    assert rows(reports["prefixed_reasons"]) == {("Booked into Detention", 1), ("Something else", 1)}
    assert rows(reports["prefixed_booked_by_facility"]) == {("ADC", 1)}
    assert reports["requests_first_day"].count() == 1
    assert {r["unique_identifier"] for r in reports["arrested_again_rows"].collect()} == {"p1"}
    assert reports["episode_map"].count() == 2
    by_reason = {r["detention_facility"]: r.asDict() for r in reports["requests_by_reason"].collect()}
    assert (by_reason["ADC"]["total"], by_reason["ADC"]["other"], by_reason["JAIL"]["NA"]) == (2, 1, 1)
    assert rows(reports["requests_per_month"]) == {("2025-11", 1), ("2025-12", 2), ("2026-01", 1)}
    assert sorted(r["CAMP"] for r in reports["rolling_population"].collect()) == [0] * 6 + [4, 5]


def test_every_report_is_written(spark, reports, tmp_path):
    chosen = ("detention_by_outcome", "occupancy_week", "types_by_day", "arrests_by_country", "requests_per_month")
    write({name: reports[name] for name in chosen}, str(tmp_path))
    back = spark.read.csv(str(tmp_path / "detention_by_outcome"), header=True)
    assert rows(back) == {("Deported from country", "1"), ("Detained as of early March", "1")}
    assert rows(spark.read.csv(str(tmp_path / "arrests_by_country"), header=True)) == {
        ("1", "Mexico", "2"), ("2", "Dem Rep of the Congo", "1")
    }
    assert rows(spark.read.csv(str(tmp_path / "requests_per_month"), header=True)) == {
        ("1", "2025-11", "1"), ("2", "2025-12", "2"), ("3", "2026-01", "1")
    }
    for df in reports.values():
        df.write.format("noop").mode("overwrite").save()


def test_reports_that_were_missing(reports):
    assert rows(reports["declined_requests"]) == set()
    assert rows(reports["arrests_of_period"]) == {(3,)} and rows(reports["stay_people"]) == {(2,)}
    assert rows(reports["types"]) == {("Targeted", 3), ("Collateral", 1)}
    assert rows(reports["days_in_use"]) == set()


def test_extract_and_days_in_use(spark, inputs):
    scope = Scope(declined="Something else", declined_at="ADC", days_of="CAMP")
    found = build(inputs, scope)
    assert [r["detainer_type"] for r in found["declined_requests"].collect()] == ["I247A - x"]
    assert {r[1] for r in rows(found["days_in_use"])} == set(range(1, 9))


def test_a_breach_fails_the_write(spark, reports, tmp_path):
    write(reports, str(tmp_path / "all"))
    debug = spark.createDataFrame([("debug", 1)], "outcome string, count long")
    with pytest.raises(ValueError, match="detention_by_outcome: 1 rows, impossible"):
        write({"detention_by_outcome": debug}, str(tmp_path / "a"))
    fewer = reports["requests_per_day"].limit(1)
    with pytest.raises(ValueError, match="different sums: .*requests_per_day"):
        write({"requests_per_day": fewer, "requests_per_month": reports["requests_per_month"]}, str(tmp_path / "b"))
    off = reports["requests_by_reason"].withColumn("total", reports["requests_by_reason"]["total"] + 1)
    with pytest.raises(ValueError, match="wrong total"):
        write({"requests_by_reason": off}, str(tmp_path / "c"))

"""Stays and stints: cohorts, outcomes, flows, durations, occupancy.

The tables have the columns described in FIXTURES.md. Quantiles and durations sort and write their counts
while they are built; nothing else here runs a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import as_date, days_between, hours_between, in_period, whole_days_between
from sojourn.functions.nulls import ascending, descending, join_null_safe
from sojourn.functions.text import passes_through, title_case
from sojourn.operators.classify import STILL_HELD, outcome, terminal
from sojourn.operators.cohort import drop_flagged, restrict_to
from sojourn.operators.counts import freq, share
from sojourn.operators.dedupe import dedupe_first
from sojourn.operators.joins import lookup, person_weights
from sojourn.operators.occupancy import Grid, changes, counts_by_place, dense, wide_counts
from sojourn.operators.paths import count_edges, path_edges
from sojourn.operators.quantiles import duration_profile, histogram
from sojourn.operators.topk import top_paths

ID = "unique_identifier"
CODE = "detention_facility_code"
PATH = "detention_facility_codes_all"
BOOK_IN = "stay_book_in_date_time"
BOOK_OUT = "stay_book_out_date_time"
PLACE = ["name", "latitude", "longitude", "state", "address"]


# Cohorts


def cohort_rule(path: Column, code: str, area: Column, area_name: str) -> Column:
    """Stays that passed through a place or were booked in by an area."""
    return passes_through(path, code) | (area == area_name)


def cohort_stays(stays: DataFrame, code: str, area_name: str, lo, hi=None) -> DataFrame:
    """Stays of the cohort booked in after ``lo``, and up to ``hi`` if given."""
    period = in_period(F.col(BOOK_IN), lo, hi, "neither" if hi is None else "right")
    return stays.where(period & cohort_rule(F.col(PATH), code, F.col("book_in_aor"), area_name))


def cohort_stints(stints: DataFrame, stays: DataFrame, lo) -> DataFrame:
    """Stints of stays booked in after ``lo``, of the people who have a stay in the cohort."""
    return restrict_to(stints.where(in_period(F.col(BOOK_IN), lo)), stays, ID)


def arrests_in(arrests: DataFrame, state: str, lo, hi=None) -> DataFrame:
    """Arrests in one state after the day ``lo``, and up to the day ``hi`` if given; flagged duplicates dropped."""
    period = in_period(F.col("apprehension_date"), lo, hi, "neither" if hi is None else "right")
    return drop_flagged(arrests, "duplicate_likely").where((F.col("apprehension_state") == state) & period)


def arrested_stays(stays: DataFrame, arrests: DataFrame) -> DataFrame:
    """Stays of arrested people, with the first arrest's criminality and the number of arrests.

    The plain merge has a row per stay and arrest; what follows keeps one of them per stay, so the
    arrests are reduced to one row per person before the join and no pairs are written out.
    """
    time = F.col("apprehension_date_time")  # a missing time is no first arrest, unless it is the only one
    first = F.min(F.struct(time.isNull().alias("undated"), time, "apprehension_criminality"))
    by_person = arrests.groupBy(ID).agg(F.count("*").alias("n_arrests"), first.alias("first"))
    by_person = by_person.select(ID, "n_arrests", "first.apprehension_criminality")
    return join_null_safe(stays, by_person, [ID])


def merged_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Number of rows and of people in the merge of two tables, without merging their rows."""
    both = join_null_safe(person_weights(left, ID, "n_left"), person_weights(right, ID, "n_right"), [ID])
    return both.agg(
        F.sum(F.col("n_left") * F.col("n_right")).alias("n_rows"), F.count("*").alias("n_people")
    )


def arrested_stints(stints: DataFrame, arrests: DataFrame) -> DataFrame:
    """Stints of arrested people without flagged duplicates; ``weight`` is the person's number of arrests.

    A stint counts once per arrest, as in the merge of the two tables.
    """
    return join_null_safe(drop_flagged(stints, "likely_duplicate"), person_weights(arrests, ID), [ID])


def latest_stays(stays: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """The most recent stay per person; of stays booked in at the same time, the first by ``tiebreak``.

    ``tiebreak`` ends with a column that leaves no ties.

    Dropping same-time duplicates first and then taking the last stay gives the same row with one
    more shuffle.
    """
    return dedupe_first(stays, [ID], [F.col(BOOK_IN).desc_nulls_first(), *ascending(*tiebreak)])


# Outcomes


def with_outcome(stays: DataFrame, still_held: str = STILL_HELD) -> DataFrame:
    return stays.withColumn("outcome", outcome(F.col("stay_release_reason"), F.col("departure_country"), still_held))


def outcome_counts(stays: DataFrame) -> DataFrame:
    return freq(with_outcome(stays), "outcome")


def terminal_counts(stays: DataFrame) -> DataFrame:
    """People per departure country, in title case; departures without a country are counted as such."""
    country = terminal(F.col("stay_release_reason"), F.col("departure_country"))
    counted = freq(stays.withColumn("country", country).where(F.col("country").isNotNull()), "country")
    return counted.withColumn("country", title_case(F.col("country")))


# Flows


def flow(stays: DataFrame, facilities: DataFrame | None = None, by_length: bool = False) -> DataFrame:
    """Counted edges of the stays' paths; with ``by_length`` per number of stints, in the same job."""
    keys = ["n_stints"] if by_length else []
    ready = with_outcome(stays).withColumn("departure_country", title_case(F.col("departure_country")))
    edges = path_edges(ready, PATH, "n_stints", "outcome", "departure_country", keys)
    return count_edges(edges, facilities, keys=keys)


def simplified_flow(
    stays: DataFrame, n_stints: int, n_paths: int, by_country: bool = False, facilities: DataFrame | None = None
) -> DataFrame:
    """Counted edges of the commonest paths of one length."""
    same = stays.where(F.col("n_stints") == n_stints)
    return flow(top_paths(same, PATH, n_paths, ["departure_country"] if by_country else []), facilities)


# Durations


def stay_lengths(stays: DataFrame) -> DataFrame:
    """Closed stays per whole days of length, commonest length first."""
    length = whole_days_between(F.col(BOOK_IN), F.col(BOOK_OUT))
    closed = stays.where(F.col(BOOK_OUT).isNotNull())
    return freq(closed.select(length.cast("long").alias("length_of_stay")), "length_of_stay")


def with_durations(stints: DataFrame) -> DataFrame:
    """Put the stint's duration in hours and in days in front."""
    start, end = F.col("book_in_date_time"), F.col("book_out_date_time")
    return stints.select(
        hours_between(start, end).alias("stint_duration_hr"), days_between(start, end).alias("stint_duration_day"), "*"
    )


def stint_profile(stints: DataFrame, facilities: DataFrame, weight: str | None = None) -> DataFrame:
    """Duration profile per facility of the closed stints, with its name and state, most people first.

    The facility's name is looked up for the finished profile rows, not for the stints.
    """
    closed = with_durations(stints.where(F.col("book_out_date_time").isNotNull()))
    profile = duration_profile(closed, CODE, "stint_duration_day", ID, weight)
    named = lookup(profile, facilities.select(CODE, "name", "state"), CODE)
    return named.select(
        "name", "avg_stint_days", "median_stint_days", "max_stint_days", "n_stints", "n_people", "state"
    ).orderBy(*descending("n_people"), F.col("name").asc_nulls_last())


def place_durations(stints: DataFrame, place: str, code: str = CODE, weight: str | None = None) -> DataFrame:
    """Durations in days of the closed stints in one place; a weight tells how often each counts."""
    here = stints.where((F.col(code) == place) & F.col("book_out_date_time").isNotNull())
    return with_durations(here).select("stint_duration_day", *([] if weight is None else [weight]))


def held_at(stints: DataFrame, code: str, after: date) -> DataFrame:
    """Stints at a facility of stays booked in after a day, flagged duplicates dropped, open ones included."""
    here = drop_flagged(stints.where(F.col(CODE) == code), "likely_duplicate")
    return here.where(in_period(as_date(F.col(BOOK_IN)), after))


def long_stay_share(durations: DataFrame, days: float, weight: str | None = None) -> DataFrame:
    longer = F.col("stint_duration_day") > days
    return durations.agg(share(longer, None if weight is None else F.col(weight)).alias("share"))


def duration_histogram(durations: DataFrame, breaks: int = 60, weight: str | None = None) -> DataFrame:
    return histogram(durations, "stint_duration_day", breaks=breaks, weight=weight)


def length_shares(stays: DataFrame) -> DataFrame:
    """Stays per number of stints and their percentage of all."""
    counted = freq(stays, "n_stints", sort="key")
    everyone = counted.agg(F.sum("count")).scalar()
    return counted.withColumn("percent", F.lit(100.0) * F.col("count") / everyone)


# Maps


def episode_map(stints: DataFrame, facilities: DataFrame) -> DataFrame:
    """Stints as dated rows with the coordinates of their place."""
    dated = stints.select(
        CODE,
        as_date(F.col("book_in_date_time")).alias("stint_start"),
        as_date(F.col("book_out_date_time")).alias("stint_end"),
        as_date(F.col(BOOK_OUT)).alias("stay_end"),
        ID,
    )
    places = facilities.select(CODE, *PLACE)
    return lookup(dated, places, CODE).select(
        "stint_start", "stint_end", "stay_end", "name", "longitude", "latitude", "address", "state", ID
    )


def place_occupancy(
    stints: DataFrame, facilities: DataFrame, grid: Grid, open_end: date, weight: str | None = None
) -> DataFrame:
    """Stints per facility and bucket, long form. Changes are summed by code, and the facility joins those sums."""
    return dense(_place_changes(stints, facilities, grid, open_end, weight), PLACE, grid)


def place_occupancy_wide(
    stints: DataFrame, facilities: DataFrame, grid: Grid, open_end: date, weight: str | None = None
) -> DataFrame:
    """Stints per facility, one column per bucket."""
    counted = counts_by_place(_place_changes(stints, facilities, grid, open_end, weight), PLACE, grid)
    return wide_counts(counted, PLACE, grid)


def _place_changes(
    stints: DataFrame, facilities: DataFrame, grid: Grid, open_end: date, weight: str | None
) -> DataFrame:
    dated = stints.withColumns(
        {
            "stint_start": as_date(F.col("book_in_date_time")),
            "stint_end": as_date(F.col("book_out_date_time")),
        }
    )
    by_code = changes(dated, [CODE], "stint_start", "stint_end", grid, open_end, weight)
    return lookup(by_code, facilities.select(CODE, *PLACE), CODE)

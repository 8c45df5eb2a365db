"""All analyses at once: from the six input tables to the tables they report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import as_date, in_period
from sojourn.functions.nulls import ascending, descending
from sojourn.functions.text import passes_through
from sojourn.operators.classify import DEPORTED
from sojourn.operators.cohort import drop_flagged, repeated, restrict_to
from sojourn.operators.counts import count_rows, freq, n_people
from sojourn.operators.occupancy import daily, weekly
from sojourn.operators.paths import path_mismatches
from sojourn.operators.quantiles import quantiles, summary
from sojourn.plans import arrests as arrest_plans
from sojourn.plans import custody, detainers, population
from sojourn.session import write_once
from sojourn.sources.sinks import sink_csv


@dataclass(frozen=True)
class Inputs:
    """The input tables, with the columns FIXTURES.md lists."""

    arrests: DataFrame
    stays: DataFrame
    stints: DataFrame
    facilities: DataFrame
    detainers: DataFrame
    population: DataFrame


@dataclass(frozen=True)
class Scope:
    """What the analyses look at."""

    # The defaults are those of the original analyses.

    state: str = "MINNESOTA"
    area: str = "St. Paul Area of Responsibility"
    facility: str = "SPMHOLD"
    places: Sequence[str] = ("BISHOP HENRY WHIPPLE FED BLDG", "ERO EL PASO CAMP EAST MONTANA")
    since: date = date(2025, 12, 1)
    prior_since: date = date(2025, 8, 24)
    shown_since: date = date(2025, 8, 1)
    types_since: date = date(2025, 9, 1)
    first_days: date = date(2025, 12, 14)
    wound_down: date = date(2026, 2, 17)
    open_end: date = date(2026, 3, 10)
    weeks: int = 14
    days: int = 91
    kept_reasons: Sequence[str] = (
        "Booked into Detention",
        "Detainer Declined by LEA",
        "No longer in State, Local, or Federal Custody",
        "NA",
    )
    type_prefix: str = "I247A"
    declined: str = "Detainer Declined by LEA"
    declined_at: str = "MINN.C.F.,ST.CLOUD"
    days_of: str = "RAADCMN"


def midnight(day: date) -> str:
    return f"{day} 00:00:00"


#: Columns that order stays of one person booked in at the same time; a caller with a stay id ends the list with it.
TIEBREAK = ("stay_book_out_date_time", custody.PATH, "stay_release_reason", "departure_country", "book_in_aor", "n_stints")

#: Reports whose files number their rows, and the order in which they do.
INDEXED = {
    "arrests_by_country": "count",
    "arrests_by_country_top_10": "count",
    "arrests_by_criminality": "count",
    "requests_per_day": "detainer_prepare_date",
    "requests_per_month": "month_year",
    "requests_by_type": "count",
}


def build(inputs: Inputs, scope: Scope = Scope(), tiebreak: Sequence[str] = TIEBREAK) -> dict[str, DataFrame]:
    """Every report by name. ``tiebreak`` orders stays of one person booked in at the same time.

    The cohorts that many reports share (arrests and stays of the period, latest stays, stints) are selected
    and written here once, so that the reports do not scan the input tables again.
    """
    arrests = drop_flagged(inputs.arrests, "duplicate_likely")
    period_arrests = write_once(custody.arrests_in(inputs.arrests, scope.state, scope.since))
    period_stays = custody.cohort_stays(inputs.stays, scope.facility, scope.area, midnight(scope.since))
    period_stays = write_once(period_stays)
    period_stints = custody.cohort_stints(inputs.stints, period_stays, midnight(scope.since))
    latest = write_once(custody.latest_stays(custody.arrested_stays(period_stays, period_arrests), tiebreak))
    stints = write_once(custody.arrested_stints(period_stints, period_arrests))
    deported = custody.with_outcome(latest).where(F.col("outcome") == DEPORTED)
    state_arrests = arrests.where(F.col("apprehension_state") == scope.state)
    typed = state_arrests.where(in_period(F.col("apprehension_date"), scope.types_since))
    requests = detainers.cleaned(inputs.detainers)
    period_requests = detainers.since(requests, scope.since)
    prefixed = detainers.of_type(period_requests, scope.type_prefix)
    prior_stays = custody.cohort_stays(
        inputs.stays, scope.facility, scope.area, midnight(scope.prior_since), midnight(scope.since)
    )
    prior_arrests = custody.arrests_in(inputs.arrests, scope.state, scope.prior_since, scope.since)

    out = {
        "arrested_people": n_people(period_arrests, custody.ID),
        "arrested_again": repeated(period_arrests, custody.ID),
        "arrested_again_rows": restrict_to(period_arrests, repeated(period_arrests, custody.ID), custody.ID),
        "merged_rows": custody.merged_rows(period_stays, period_arrests),
        "release_reasons": freq(latest, "stay_release_reason"),
        "detention_by_outcome": custody.outcome_counts(latest),
        "deportation_by_country": custody.terminal_counts(latest),
        "deported_by_criminality": freq(deported, "apprehension_criminality"),
        "stay_countries": freq(period_stays, "departure_country"),
        "stay_release_reasons": freq(period_stays, "stay_release_reason"),
        "length_shares": custody.length_shares(latest),
        "length_p90": quantiles(latest, "n_stints", {"p90": 0.9}),
        "path_mismatches": path_mismatches(latest, custody.PATH, "n_stints"),
        "flow_by_length": custody.flow(latest, inputs.facilities, by_length=True),
        "flow_2_simplified": custody.simplified_flow(latest, 2, 4, by_country=True, facilities=inputs.facilities),
        "flow_3_simplified": custody.simplified_flow(latest, 3, 9, facilities=inputs.facilities),
        "stay_lengths": custody.stay_lengths(latest),
        "episode_map": custody.episode_map(stints, inputs.facilities),
        "stint_lengths": custody.stint_profile(stints, inputs.facilities, weight="weight"),
        "prior_release_reasons": freq(
            custody.arrested_stays(prior_stays, prior_arrests), "stay_release_reason", weight="n_arrests"
        ),
        "daily_arrests": arrest_plans.daily_wide(arrests, scope.shown_since),
        "rolling_arrests": arrest_plans.rolling_wide(arrests, scope.shown_since),
        "arrests_by_country": arrest_plans.by_country(period_arrests),
        "arrests_by_country_top_10": arrest_plans.top_countries(period_arrests),
        "arrests_by_case_status": freq(period_arrests, "case_status"),
        "arrests_by_criminality": freq(period_arrests, "apprehension_criminality"),
        "arrests_of_period": count_rows(period_arrests),
        "arrests_after": arrest_plans.daily_after(period_arrests, scope.wound_down),
        "types": freq(typed, "apprehension_type"),
        "types_by_day": arrest_plans.type_by_day(typed),
        "types_by_period": arrest_plans.type_by_period(
            typed,
            {
                "before": (None, scope.since, "neither"),
                "period": (scope.since, None, "neither"),
                "first days": (scope.since, scope.first_days, "right"),
            },
        ),
        "requests_per_day": detainers.per_day(requests),
        "requests_per_month": detainers.per_month(requests),
        "requests_by_type": freq(period_requests, "detainer_type"),
        "requests_by_reason": detainers.by_reason(period_requests, scope.kept_reasons),
        "prefixed_by_reason": detainers.by_reason(prefixed),
        "prefixed_reasons": freq(prefixed, detainers.REASON),
        "prefixed_booked_by_facility": freq(
            prefixed.where(F.col(detainers.REASON) == scope.kept_reasons[0]), detainers.SITE
        ),
        "declined_requests": detainers.extract(prefixed, scope.declined_at, scope.declined),
        "requests_first_day": detainers.on_day(requests, scope.since),
        "population": population.population_wide(inputs.population),
        "rolling_population": population.rolling_population(inputs.population),
        "days_in_use": population.days_in_use(inputs.population, scope.days_of),
    }

    # columns that an input may lack
    if "final_order_yes_no" in latest.columns:
        out["deported_by_final_order"] = freq(deported, "final_order_yes_no")
    if "detention_facility_last" in period_stays.columns:
        out["last_facilities"] = freq(period_stays, "detention_facility_last")

    for i, place in enumerate(scope.places, 1):
        durations = custody.place_durations(stints, place, "detention_facility", "weight")
        out[f"durations_{i}"] = durations
        out[f"long_stays_{i}"] = custody.long_stay_share(durations, 2, "weight")
        out[f"histogram_{i}"] = custody.duration_histogram(durations, weight="weight")

    held = custody.held_at(inputs.stints, scope.facility, scope.since)
    out["held_people"] = n_people(held, custody.ID)
    out["held_summary"] = summary(custody.with_durations(held), "stint_duration_hr")
    stays_since = inputs.stays.where(
        passes_through(F.col(custody.PATH), scope.facility) & in_period(as_date(F.col(custody.BOOK_IN)), scope.since)
    )
    out["stay_people"] = n_people(stays_since, custody.ID)
    out["held_not_arrested"] = arrest_plans.held_not_arrested(stays_since, period_arrests)

    for name, grid in (("week", weekly(scope.since, scope.weeks)), ("day", daily(scope.since, scope.days))):
        out[f"occupancy_{name}"] = custody.place_occupancy_wide(
            stints, inputs.facilities, grid, scope.open_end, weight="weight"
        )
    return out


#: Rows that must not be in a report, as a condition over its columns.
IMPOSSIBLE = {
    "detention_by_outcome": "outcome IS NULL OR outcome = 'debug'",
    "flow_by_length": "step_to > n_stints + 2",
    "flow_2_simplified": "step_to > 4",
    "flow_3_simplified": "step_to > 5",
}
#: Sums over reports that must be equal, wherever two of them are written together.
EQUAL = (
    {"requests_per_day": "count", "requests_per_month": "count"},
    {"arrests_of_period": "count", "arrests_by_country": "count", "arrests_by_case_status": "count", "arrests_by_criminality": "count"},
    {"types": "count", "types_by_day": None},
    {"detention_by_outcome": "count", "release_reasons": "count", "length_shares": "count", "flow_by_length": "IF(step_from = 1, count, 0)"},
    {"requests_by_reason": "total", "requests_by_type": "count"},
    {"prefixed_by_reason": "total", "prefixed_reasons": "count"},
)


def _checks(name: str, df: DataFrame) -> dict[str, Column]:
    """What is measured while a report is written: its impossible rows, rows with a wrong total, and its sums."""
    found = {}
    if name in IMPOSSIBLE:
        found["impossible"] = F.count_if(F.expr(IMPOSSIBLE[name]))
    if "total" in df.columns:
        cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in df.columns[1:] if c != "total"]
        found["wrong total"] = F.count_if(F.col("total") != sum(cells, F.lit(0)))
    for sums in EQUAL:
        if name in sums:
            cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in df.columns[1:]]
            value = sum(cells, F.lit(0)) if sums[name] is None else F.expr(sums[name])
            found["sum"] = F.coalesce(F.sum(value), F.lit(0))
    return found


def write(reports: Mapping[str, DataFrame], folder: str) -> None:
    """Write each report as a folder of CSV files below ``folder``; those in ``INDEXED`` with a row index.

    What has to hold in a report, and between reports, is measured in the jobs that write them; a breach raises
    ValueError once all of them are written.
    """
    measured = {}
    for name, df in reports.items():
        key = INDEXED.get(name)
        if key is None:
            index = None
        elif key == "count":
            index = [*descending("count"), *ascending(*[c for c in df.columns if c != "count"])]
        else:
            index = ascending(key)
        measured[name] = sink_csv(df, f"{folder}/{name}", index, measure=_checks(name, df))
    breaches = [f"{name}: {n} rows, {what}" for name, m in measured.items() for what, n in m.items() if what != "sum" and n]
    for sums in EQUAL:
        found = {name: measured[name]["sum"] for name in sums if name in measured}
        if len(set(found.values())) > 1:
            breaches.append(f"different sums: {found}")
    if breaches:
        raise ValueError("; ".join(breaches))

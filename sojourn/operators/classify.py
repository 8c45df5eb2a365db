"""Ordered rules: the first that holds gives the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.nulls import is_in

# Labels and reasons the outcome rules use.
DEPORTED = "Deported from country"
VOLUNTARY = "Voluntary departure"
LEFT = "Left country (other)"
RELEASED = "Released from detention"
UNCLEAR = "Unclear or other outcome"
DIED = "Died"
REMOVED_REASON = "Removed"
VOLUNTARY_REASON = "Voluntary departure"
DIED_REASON = "Died"
RELEASED_REASONS = (
    "Order of recognizance",
    "Bonded Out - IJ",
    "Proceedings Terminated",
    "Order of supervision",
    "Relief Granted by IJ",
    "Order of Recognizance - Humanitarian",
    "Order of Supervision - Re-Release",
    "Paroled",
    "ORR - Office of Refugee Resettlement",
    "Paroled - Humanitarian",
    "Bonded Out - Field Office",
    "Court Ordered",
)
UNCLEAR_REASONS = (
    "Transferred",
    "U.S. Marshals or other agency (explain in Detention Comments)",
    "Withdrawal",
)
STILL_HELD = "Detained as of early March"
NO_COUNTRY = "No country listed"
#: Label of a row that no rule covers. It must stay empty.
UNMATCHED = "debug"


def classify(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Fold ordered (condition, label) rules into one expression; without default, no match is null."""
    (cond, label), *rest = rules
    out = F.when(cond, F.lit(label))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))


def outcome(reason: Column, country: Column, still_held: str = STILL_HELD) -> Column:
    """Outcome of a stay from its release reason and departure country."""
    return classify(
        [
            (reason == REMOVED_REASON, DEPORTED),
            (reason == VOLUNTARY_REASON, VOLUNTARY),
            (country.isNotNull(), LEFT),
            (is_in(reason, RELEASED_REASONS), RELEASED),
            (reason.isNull(), still_held),
            (is_in(reason, UNCLEAR_REASONS), UNCLEAR),
            (reason == DIED_REASON, DIED),
        ],
        default=UNMATCHED,
    )


def terminal(reason: Column, country: Column) -> Column:
    """Country a stay ended in, a stand-in if the reason implies one that is not listed, else null."""
    departed = is_in(reason, (REMOVED_REASON, VOLUNTARY_REASON))
    return F.coalesce(country, F.when(departed, F.lit(NO_COUNTRY)))


def unmatched(df: DataFrame, label: str) -> DataFrame:
    """The rows no rule covered."""
    return df.where(F.col(label) == UNMATCHED)

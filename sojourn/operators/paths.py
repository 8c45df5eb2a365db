"""Flows between places: which step leads from where to where, and how often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending
from sojourn.functions.text import split_path
from sojourn.operators.joins import crosswalk, label_codes
from sojourn.operators.topk import sorted_once
from sojourn.session import write_once

EDGE = ["source", "dest", "step_from", "step_to"]
#: What an edge leads to: the next place, the outcome, or the country behind the outcome.
TO_PLACE, TO_OUTCOME, TO_TERMINAL = 0, 1, 2


def path_edges(
    df: DataFrame, path: str, n_stints: str, outcome: str, terminal: str, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per step of each stay, from path strings such as ``"A; B; "``.

    A stay of N stints gives N-1 steps between places, one to its outcome, and one from there to its
    terminal country if it has one. ``kind`` tells them apart.
    """
    codes = F.slice(split_path(F.col(path)), F.lit(1), F.col(n_stints))
    ends = F.array(F.col(outcome))
    ends = F.when(F.col(terminal).isNotNull(), F.array(F.col(outcome), F.col(terminal))).otherwise(ends)
    stops = df.select(*keys, F.size(codes).alias("n"), F.concat(codes, ends).alias("stops"))
    tail = F.size("stops") - 1
    pairs = F.arrays_zip(
        F.slice("stops", F.lit(1), tail).alias("source"), F.slice("stops", F.lit(2), tail).alias("dest")
    )
    steps = stops.select(*keys, "n", F.posexplode(pairs).alias("at", "pair"))
    kind = F.when(F.col("at") + 1 < F.col("n"), TO_PLACE).when(F.col("at") + 1 == F.col("n"), TO_OUTCOME)
    return steps.select(
        *keys,
        F.col("pair.source").alias("source"),
        F.col("pair.dest").alias("dest"),
        (F.col("at") + 1).alias("step_from"),
        (F.col("at") + 2).alias("step_to"),
        kind.otherwise(TO_TERMINAL).alias("kind"),
    )


def path_mismatches(df: DataFrame, path: str, n_stints: str) -> DataFrame:
    """Number of stays whose path does not have as many places as the stay has stints."""
    differs = F.size(split_path(F.col(path))) != F.col(n_stints)
    return df.agg(F.count_if(differs).alias("n_mismatched"), F.count("*").alias("n_rows"))


def stint_edges(
    stints: DataFrame,
    stays: DataFrame,
    stay: str,
    place: str,
    order: Sequence[str],
    outcome: str,
    terminal: str,
    by_length: bool = False,
) -> DataFrame:
    """The steps of :func:`path_edges` from one row per stint instead of path strings.

    ``order`` leaves no ties that matter. With ``by_length`` each step carries the ``n_stints`` of its stay.
    One plan serves stays of all sizes, see :func:`numbered_steps`.
    """
    # written: both kinds of edges below read the numbered rows, whose windows then run once
    steps = write_once(numbered_steps(stints, stay, place, order))
    keys = []
    if by_length:
        sizes = steps.where("is_last").select("stay", F.col("step").alias("n_stints"))
        steps, keys = steps.join(sizes, "stay"), ["n_stints"]
    # codes may be numbers, which are shorter than text in the shuffle
    at, here = F.col("step"), F.col("place").cast("string")
    onward = steps.where(~F.col("is_last")).select(
        *keys, here.alias("source"), F.col("next_place").cast("string").alias("dest"), at.alias("step_from"),
        (at + 1).alias("step_to"), F.lit(TO_PLACE).alias("kind"),
    )
    ends = stays.select(F.col(stay).alias("stay"), F.col(outcome).alias("outcome"), F.col(terminal).alias("terminal"))
    last = steps.where("is_last").join(ends, "stay")

    def edge(source: Column, dest: Column, step: Column, kind: int) -> Column:
        return F.struct(
            source.alias("source"), dest.alias("dest"), step.alias("step_from"), (step + 1).alias("step_to"),
            F.lit(kind).alias("kind"),
        )

    to_outcome = edge(here, F.col("outcome"), at, TO_OUTCOME)
    to_terminal = edge(F.col("outcome"), F.col("terminal"), at + 1, TO_TERMINAL)
    closing = F.when(F.col("terminal").isNull(), F.array(to_outcome)).otherwise(F.array(to_outcome, to_terminal))
    return onward.unionByName(last.select(*keys, F.explode(closing).alias("e")).select(*keys, "e.*"))


def numbered_steps(stints: DataFrame, stay: str, place: str, order: Sequence[str]) -> DataFrame:
    """``(stay, step, place, next_place, is_last)`` of every stint; rows without a stay are left out.

    One sort by stay and order spreads also a single stay over many parts. Within a part, windows over its
    rows find a stay's begin and the next row; a stay that goes on from an earlier part, or into a later one,
    needs only what the parts tell about their first and last stays, two rows each.
    """
    rows = stints.where(F.col(stay).isNotNull()).select(F.col(stay).alias("stay"), *order, F.col(place).alias("place"))
    rows = sorted_once(rows, ascending("stay", *order), ["stay", "place"])
    parts = rows.groupBy("part").agg(
        F.min_by("stay", "at").alias("first_stay"),
        F.min_by(F.struct("stay", "place"), "at").alias("head"),
        F.max_by("stay", "at").alias("last_stay"),
        F.max("at").alias("last_at"),
    )
    parts = write_once(parts)  # a row per part
    at_ends = rows.join(F.broadcast(parts), "part").where("stay = first_stay OR stay = last_stay")
    runs = at_ends.groupBy("part", "stay").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("stay").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried")
    carried = runs.select("part", F.col("stay").alias("first_stay"), carried)
    following = F.lead("head").over(Window.orderBy("part"))  # over a row per part
    edges_of_parts = parts.withColumn("next_head", following).join(carried, ["part", "first_stay"]).select(
        "part", "first_stay", "last_at", "next_head", "carried"
    )
    in_part = Window.partitionBy("part").orderBy("at")
    begins = F.lag("stay").over(in_part).isNull() | (F.lag("stay").over(in_part) != F.col("stay"))
    marked = rows.select(
        "*",
        F.when(begins, F.col("at")).alias("begin"),
        F.lead(F.struct("stay", "place")).over(in_part).alias("next"),
    )
    begin = F.max("begin").over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.withColumn("begin", begin).join(F.broadcast(edges_of_parts), "part")
    following = F.when(F.col("at") == F.col("last_at"), F.col("next_head")).otherwise(F.col("next"))
    before = F.when(F.col("stay") == F.col("first_stay"), F.col("carried")).otherwise(0)
    placed = placed.select(
        "stay", (F.col("at") - F.col("begin") + 1 + before).cast("int").alias("step"), "place", following.alias("next")
    )
    is_last = F.col("next").isNull() | (F.col("next.stay") != F.col("stay"))
    return placed.select("stay", "step", "place", F.col("next.place").alias("next_place"), is_last.alias("is_last"))


def count_edges(
    edges: DataFrame,
    facilities: DataFrame | None = None,
    code: str = "detention_facility_code",
    name: str = "name",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Stays per edge. Place codes are replaced by their names, or stay as they are if unnamed.

    Edges are counted by code first, so that the lookup joins see one row per different edge, and again by name.
    """
    if facilities is None:
        return edges.groupBy(*keys, *EDGE).agg(F.count("*").alias("count"))
    by_code = edges.groupBy(*keys, *EDGE, "kind").agg(F.count("*").alias("count"))
    # written, so that its size is known: Spark then broadcasts it where it is small, and the edges need no shuffle
    named = _named(by_code, write_once(crosswalk(facilities, code, name)))
    return named.groupBy(*keys, *EDGE).agg(F.sum("count").alias("count"))


def _named(edges: DataFrame, names: DataFrame) -> DataFrame:
    kind = F.col("kind")
    labelled = label_codes(edges, names, F.when(kind < TO_TERMINAL, F.col("source")), "__from")
    labelled = label_codes(labelled, names, F.when(kind == TO_PLACE, F.col("dest")), "__to")
    return labelled.withColumns({"source": F.coalesce("__from", "source"), "dest": F.coalesce("__to", "dest")})

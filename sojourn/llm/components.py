"""Connected components of an undirected graph, by alternating star operations (Kiveris et al., 2014)."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.session import stored, write_once


def _stars(edges: DataFrame, large: bool, tables: ExitStack) -> DataFrame:
    """Hang each node's larger (or its smaller) neighbours and itself under the smallest of them.

    The smallest neighbours are written, so that their join has a shuffle of its own and Spark can split the
    neighbours of a node that has many.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    least = tables.enter_context(stored(least))
    hung = near.where("v > u") if large else near
    moved = hung.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("least").alias("v")))
    return tables.enter_context(stored(moved.where("u <> v").distinct()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that links lead to.

    `edges` has two columns of one type; order, repeats and loops don't matter, and an edge with a null
    is left out. Each round is written to the shared folder and replaces the one before; there are about
    log n of them.
    """
    u, v = edges.columns
    before, tables = None, ExitStack()
    now = tables.enter_context(stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()))
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
            with tables:
                return write_once(roots)
        before = state
        with tables:
            tables = ExitStack()
            now = _stars(_stars(now, True, tables), False, tables)

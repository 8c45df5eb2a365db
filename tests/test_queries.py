"""Every registered query against its SQL, and the invariants the analyses have to keep."""

import re

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry
from sojourn.plans import registry
from sojourn.session import release

QUERIES, ORACLES = dict(registry.QUERIES), dict(registry.ORACLES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = duck_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected
    release(spark)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "dest", "step_from", "step_to", "count"]
    assert df.count() > 0


def test_period_filters_reach_the_scan(spark, sf_dir, capsys):
    QUERIES["view_scan"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_orderdate", plan)
    assert re.search(r"PushedFilters: \[.*StringContains\(o_orderpriority,HIGH\)", plan)
    assert "o_totalprice" not in plan.split("ReadSchema")[1].splitlines()[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_join(spark, sf_dir, name):
    """No query pairs all rows of two tables, also where nothing may be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _sum(df, col="count"):
    return df.agg({col: "sum"}).first()[0]


def test_outcomes_cover_everyone_once(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().count()
    outcomes = QUERIES["outcome_counts"](spark, sf_dir)
    assert _sum(outcomes) == people
    assert outcomes.where("outcome = 'debug'").count() == 0


def test_countries_add_up_to_departures(spark, sf_dir):
    left = ("Deported from country", "Voluntary departure", "Left country (other)")
    departed = QUERIES["outcome_counts"](spark, sf_dir).where(f"outcome IN {left}")
    assert _sum(QUERIES["terminal_counts"](spark, sf_dir)) == _sum(departed)


def test_first_edges_count_the_stays_of_each_length(spark, sf_dir):
    edges = QUERIES["path_edges_by_length"](spark, sf_dir)
    first = {r[0]: r[1] for r in edges.where("step_from = 1").groupBy("n_stints").sum("count").collect()}
    stays = {r["n_stints"]: r["count"] for r in QUERIES["length_shares"](spark, sf_dir).collect()}
    assert first == stays
    last = {r[0]: r[1] for r in edges.groupBy("n_stints").max("step_to").collect()}
    assert last == {k: k + 2 for k in stays}


def test_days_and_months_add_up(spark, sf_dir):
    assert _sum(QUERIES["requests_per_day"](spark, sf_dir)) == _sum(QUERIES["requests_per_month"](spark, sf_dir))


def test_reason_cells_add_up_to_totals(spark, sf_dir):
    for row in QUERIES["requests_by_reason"](spark, sf_dir).collect():
        cells = row.asDict()
        total = cells.pop("total")
        cells.pop("detention_facility")
        assert sum(v or 0 for v in cells.values()) == total


def test_wide_days_add_up_to_types(spark, sf_dir):
    rows = QUERIES["type_by_day"](spark, sf_dir).collect()
    daily = spark.read.parquet(f"{sf_dir}/events.parquet").where("value <= 200 AND value >= 0.5").count()
    assert sum(r["Collateral"] + r["Targeted"] + r["NA"] for r in rows) == daily

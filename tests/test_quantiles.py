import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.operators.quantiles import duration_profile, histogram, quantiles, summary

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def test_interpolates(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert quantiles(rows, "v", {"p": 0.9}).first()["p"] == pytest.approx(3.7)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    n = 4000
    # one key holds most rows; ties, negative, tiny, huge and clustered values
    keys = rng.choice(["hot", "b", "c", None], n, p=[0.7, 0.15, 0.1, 0.05])
    kinds = [
        rng.exponential(9, n), np.round(rng.normal(0, 3, n)), rng.normal(0, 1e-7, n), rng.normal(1e9, 5, n),
        np.full(n, 7.25), -rng.exponential(1e4, n),
    ]
    v = np.choose(rng.integers(0, len(kinds), n), kinds)
    return [(k, float(x) if rng.random() > 0.02 else None, int(w)) for k, x, w in zip(keys, v, rng.integers(1, 4, n))]


@pytest.mark.parametrize("weight", [None, "w"])
def test_matches_numpy(spark, values, weight):
    rows = spark.createDataFrame(values, "k string, v double, w int").repartition(5)
    found = {r["k"]: r for r in quantiles(rows, "v", PROBS, ["k"], weight).collect()}
    assert set(found) == {"hot", "b", "c", None}
    for key, row in found.items():
        v = [x for k, x, w in values if k == key and x is not None for _ in range(w if weight else 1)]
        expected = np.quantile(v, list(PROBS.values()))
        assert [row[p] for p in PROBS] == pytest.approx(list(expected), rel=1e-12, abs=1e-15)


def test_special_values_have_one_order(spark):
    """NaN is the largest value, infinities lie at the ends, and -0.0 is 0."""
    nan, inf = float("nan"), float("inf")

    def median(*values):
        return quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"p": 0.5}).first()["p"]

    for copies in (1, 3000):
        assert median(*[1.0, 2.0, 3.0, nan, nan] * copies) == 3.0
    assert math.isnan(median(1.0, nan, nan)) and math.isnan(median(1.0, nan))
    assert median(-inf, -inf, 5.0, inf) == -inf and median(inf, inf) == inf
    assert median(-0.0, 0.0, 0.0) == 0.0
    assert median(1e15 + 1, 1e15 + 2, 1e15 + 3, 1e15 + 5) == 1e15 + 2.5


def test_single_value_groups(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("b", 0.0)], "k string, v double")
    found = {r["k"]: tuple(r)[1:] for r in quantiles(rows, "v", PROBS, ["k"]).collect()}
    assert found == {"a": (5.0,) * 5, "b": (0.0,) * 5}


def test_summary_counts_nulls(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (6.0,), (None,)], "v double")
    assert summary(rows, "v").first().asDict() == {
        "min": 1.0, "q1": 1.5, "median": 2.0, "mean": 3.0, "q3": 4.0, "max": 6.0, "n_null": 1,
    }


def test_profile_counts_missing_people_once_and_weights_rows(spark):
    rows = spark.createDataFrame(
        [("A", 1.0, "p", 2), ("A", 4.0, "q", 1), ("A", 7.0, None, 1), ("A", 8.0, None, 1), ("B", 3.0, "p", 1)],
        "place string, d double, id string, w int",
    )
    plain = {r["place"]: r for r in duration_profile(rows, "place", "d", "id").collect()}
    assert plain["A"].asDict() == {
        "place": "A", "avg_stint_days": 5.0, "median_stint_days": 5.5, "max_stint_days": 8.0, "n_stints": 4, "n_people": 3,
    }
    weighted = {r["place"]: r for r in duration_profile(rows, "place", "d", "id", "w").collect()}
    repeated = rows.withColumn("w", F.explode(F.sequence(F.lit(1), "w")))
    expected = {r["place"]: r for r in duration_profile(repeated, "place", "d", "id").collect()}
    assert weighted == expected


def test_histogram_bins_are_closed_on_the_right(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.1,), (None,)], "v double")
    found = {(r["bin_from"], r["bin_to"]): r["count"] for r in histogram(rows, "v", width=1).collect()}
    assert found == {(0.0, 1.0): 2, (1.0, 2.0): 2, (2.0, 3.0): 1}


@pytest.mark.parametrize(("top", "width"), [(60.0, 1.0), (85.0, 2.0), (6.0, 0.1), (600.0, 10.0), (200.0, 5.0)])
def test_histogram_takes_round_widths(spark, top, width):
    rows = spark.createDataFrame([(0.0,), (top,)], "v double")
    first = histogram(rows, "v", breaks=60).orderBy("bin_from").first()
    assert first["bin_to"] - first["bin_from"] == pytest.approx(width)
    with pytest.raises(ValueError):
        histogram(rows, "v")


@pytest.mark.parametrize(("value", "edges"), [(5.0, (5.0, 5.1)), (0.0, (0.0, 1.0)), (-3.0, (-3.0, -2.95))])
def test_histogram_of_equal_values_is_one_bin(spark, value, edges):
    rows = spark.createDataFrame([(value,)] * 4, "v double")
    (found,) = histogram(rows, "v", breaks=60).collect()
    assert found["count"] == 4 and found["bin_from"] <= value <= found["bin_to"]
    assert (found["bin_from"], found["bin_to"]) == pytest.approx(edges)

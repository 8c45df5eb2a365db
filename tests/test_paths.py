import random

import pytest
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending
from sojourn.operators.paths import count_edges, path_edges, path_mismatches, stint_edges
from sojourn.operators.topk import top_paths, with_row_index
from sojourn.plans import custody

STAY = "path string, n int, out string, country string"


def edges_of(df):
    rows = df.select("source", "dest", "step_from", "step_to").collect()
    return sorted(tuple(r) for r in rows)


def test_edges_of_a_path(spark):
    df = spark.createDataFrame([("A; B; ", 2, "X", None)], STAY)
    assert edges_of(path_edges(df, "path", "n", "out", "country")) == [("A", "B", 1, 2), ("B", "X", 2, 3)]
    df = spark.createDataFrame([("A; B; ", 2, "X", "Y")], STAY)
    assert edges_of(path_edges(df, "path", "n", "out", "country"))[-1] == ("X", "Y", 3, 4)
    df = spark.createDataFrame([("A; ", 1, "X", "Y")], STAY)
    assert edges_of(path_edges(df, "path", "n", "out", "country")) == [("A", "X", 1, 2), ("X", "Y", 2, 3)]


def test_longer_path_is_cut_to_its_stints_and_counted(spark):
    df = spark.createDataFrame([("A; B; C; ", 2, "X", None), ("A; ", 1, "X", None)], STAY)
    assert edges_of(path_edges(df, "path", "n", "out", "country")) == [
        ("A", "B", 1, 2), ("A", "X", 1, 2), ("B", "X", 2, 3)
    ]
    assert path_mismatches(df, "path", "n").first().asDict() == {"n_mismatched": 1, "n_rows": 2}


def test_names_fall_back_to_codes_and_spare_outcomes(spark):
    # an outcome that looks like a code must not be looked up; two codes share a name
    df = spark.createDataFrame([("A; Q; ", 2, "B", None), ("B; Q; ", 2, "B", "A")], STAY)
    names = spark.createDataFrame([("A", "Place"), ("B", "Place"), (None, "none")], "code string, name string")
    counted = count_edges(path_edges(df, "path", "n", "out", "country"), names, "code")
    assert sorted(tuple(r) for r in counted.collect()) == [
        ("B", "A", 3, 4, 1), ("Place", "Q", 1, 2, 2), ("Q", "B", 2, 3, 2)
    ]


@pytest.fixture(scope="module")
def stints():
    rng = random.Random(5)
    sizes = {1: 700, 2: 1, 3: 5, 4: 40, 5: 2}
    rows = [(stay, rng.randint(1, 9), i, rng.choice([*"ABC", None])) for stay, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_stays_across_parts_give_their_edges(spark, stints, parts):
    """One stay has most of the rows; with many parts it covers several of them whole."""
    rows = spark.createDataFrame(stints, "stay int, a int, b int, place string").repartition(7)
    rows = rows.union(spark.createDataFrame([(None, 1, 1, "A")], rows.schema))
    ends = spark.createDataFrame([(1, "X", "Y"), (2, "X", None), (3, "Z", "W"), (4, "X", None)], "stay int, o string, c string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = stint_edges(rows, ends, "stay", "place", ["a", "b"], "o", "c", by_length=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = []
    for stay, out, country in ((1, "X", "Y"), (2, "X", None), (3, "Z", "W"), (4, "X", None), (5, None, None)):
        stops = [r[3] for r in sorted((r for r in stints if r[0] == stay), key=lambda r: r[1:3])]
        n = len(stops)
        stops += ([out] if out else []) + ([country] if country else [])
        expected += [(n, s, d, i + 1, i + 2) for i, (s, d) in enumerate(zip(stops, stops[1:]))]
    assert sorted(repr(tuple(r)[:5]) for r in found) == sorted(map(repr, expected))


def test_row_index_per_key_and_over_all(spark, stints):
    rows = spark.createDataFrame(stints, "stay int, a int, b int, place string").repartition(6)
    found = with_row_index(rows, ascending("a", "b"), "i", by=["stay"]).collect()
    for stay in (1, 2, 3, 4, 5):
        mine = sorted((r["a"], r["b"], r["i"]) for r in found if r["stay"] == stay)
        assert [i for *_, i in mine] == list(range(1, len(mine) + 1))
    every = with_row_index(rows, [F.col("b").desc(), *ascending("stay")], "i").orderBy("i").collect()
    assert [r["i"] for r in every] == list(range(1, len(stints) + 1))
    assert [(-r["b"], r["stay"]) for r in every] == sorted((-r[2], r[0]) for r in stints)


def test_top_paths_keep_all_rows_on_the_paths(spark):
    rows = [("p", "x")] * 4 + [("p", "y")] * 3 + [("q", None)] * 2 + [("r", "x")]
    df = spark.createDataFrame(rows, "path string, c string")
    kept = top_paths(df, "path", 2, ["c"])
    assert {r["path"] for r in kept.collect()} == {"p"} and kept.count() == 7
    assert top_paths(df, "path", 2).count() == 9


def test_flow_by_length_and_simplified(spark):
    schema = "detention_facility_codes_all string, n_stints int, stay_release_reason string, departure_country string"
    rows = [("A; B; ", 2, "Removed", "MEXICO")] * 3 + [("A; C; ", 2, None, None)] + [("A; ", 1, "Died", None)]
    stays = spark.createDataFrame(rows, schema)
    by_length = custody.flow(stays, by_length=True)
    found = {tuple(r) for r in by_length.collect()}
    assert (2, "Deported from country", "Mexico", 3, 4, 3) in found
    assert (1, "A", "Died", 1, 2, 1) in found
    assert by_length.where("step_from = 1").agg(F.sum("count")).first()[0] == 5
    top = {tuple(r) for r in custody.simplified_flow(stays, 2, 1, by_country=True).collect()}
    assert top == {
        ("A", "B", 1, 2, 3), ("B", "Deported from country", 2, 3, 3), ("Deported from country", "Mexico", 3, 4, 3)
    }

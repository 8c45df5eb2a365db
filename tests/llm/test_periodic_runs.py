"""Periodic runs against a plain search, over tiles of all octaves."""

import random

import brute
import numpy as np
import pytest
from sojourn.llm import periods
from sojourn.llm.periods import looped, periodic_runs, run_digests
from sojourn.llm.queries import QUERIES
from sojourn.session import release


def solved(x):
    """The runs that the tiles of a sequence find, stitched in Python."""
    pieces = {}
    for s, place, core, boundaries in periods.tiles_of(x):
        before = 0 if s == 1 else min(s, place)
        words = x[place : place + core + periods.SHORT] if s == 1 else x[place - before : place + core + 3 * s]
        if s == 1:
            found = periods.solve_short(words, core, place == 0)
        else:
            found = periods.solve_octave(words, s, (boundaries + before).tolist())
        for q, begin, end in found:
            pieces.setdefault(q, []).append((begin + place - before, end + place - before))
    runs = []
    for q, parts in pieces.items():
        joined = []
        for begin, end in sorted(parts):
            if joined and begin <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([begin, end])
        runs += [(b, e - b + q, q) for b, e in joined if e - b >= periods.least_places(q)]
    return sorted(runs)


def sequences():
    rng = random.Random(4)
    for alphabet in (1, 2, 3, 50):
        for n in (0, 1, 5, 6, 7, 23, 31, 32, 33, 64, 200, 700):
            yield [rng.randrange(alphabet) for _ in range(n)]
    for period in (1, 3, 7, 8, 9, 15, 16, 17, 40, 64, 100):
        for times in (3.9, 4, 4.1, 6, 11):
            block = [rng.randrange(5) for _ in range(period)]
            body = [block[i % period] for i in range(int(period * times))]
            noise = [rng.randrange(5) for _ in range(rng.randrange(60))]
            yield noise + body + noise[::-1]
            yield body + noise + body
    yield [0] * 40 + [1] + [0] * 40
    yield ([0, 1] * 20 + [2]) * 5
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("core", [1024, 16, 64])
def test_tiles_find_all_runs(monkeypatch, core):
    monkeypatch.setattr(periods, "CORE", core)
    for x in sequences():
        assert solved(np.array(x, np.int32)) == brute.periodic_runs(x), x


def test_long_periods_go_over_many_tiles():
    rng = np.random.default_rng(5)
    block = rng.integers(0, 1000, 3000).astype(np.int32)
    x = np.r_[rng.integers(0, 1000, 777), np.tile(block, 5)[:13_000], rng.integers(0, 1000, 99)].astype(np.int32)
    (run,) = solved(x)
    assert run[2] == 3000 and run[1] >= 13_000
    assert solved(np.zeros(20_000, np.int32)) == [(0, 20_000, 1)]


def test_query_matches_plain_search(spark, sf_dir):
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    rows = {r[0]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert rows == {d: brute.run_row(d, t) for d, t in texts.items()}
    assert sum(r[0] > 0 for r in rows.values()) > 5
    release(spark)


def test_odd_rows(spark, odd_docs, no_docs):
    long = [(100, "la " * 100_000 + "end"), (None, "x y " * 30), (None, "x y " * 30), (101, " ".join(map(str, range(200_000))))]
    docs = odd_docs.unionByName(spark.createDataFrame(long, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.selectExpr("*", "1 AS key", "2 AS runs", "3 AS period", "4 AS `begin`", "5 AS marked")
    for change in (lambda d: d, looped):
        rows = [tuple(r) for r in run_digests(periodic_runs(change(docs))).collect()]
        given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if change is looped:
            want = [(d, *brute.run_row(d, t)) for d, t in given if d not in (100, 101)]
            assert sorted(map(repr, (r for r in rows if r[0] not in (100, 101)))) == sorted(map(repr, want))
        else:
            by_id = {r[0]: r for r in rows}
            assert by_id[100][1:6] == (1, 0, 100_000, 1, 100_000_000)
            assert len(rows) == len(given) and by_id[None][1] in (0, 1)
    assert periodic_runs(no_docs).collect() == []
    release(spark)

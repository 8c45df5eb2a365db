"""The Pitman-Yor model: exact counts, probabilities that add up to 1, a sampler with the right distribution."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from sojourn.llm import pitman_yor
from sojourn.llm.pitman_yor import language_model_scores, restaurant, seat
from sojourn.llm.queries import QUERIES
from sojourn.session import release
from pyspark.sql import functions as F


def tokens(text):
    return [*brute.words((text or "").translate(brute.LOWER)), None]


def base_rows(docs, train):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    c = Counter(t for d, text in docs if train(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for d, text in docs:
        found = tokens(text)
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in found)
        out.append((d, not train(d), len(found), sum(c[t] > 0 for t in found), n, pytest.approx(base, rel=1e-9, abs=1e-9)))
    return out


@pytest.mark.parametrize("size", [1 << 24, 1 << 12])
def test_query_counts(spark, sf_dir, monkeypatch, size):
    monkeypatch.setattr(pitman_yor, "SLICE", size)
    docs = sorted(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    rows = sorted(map(tuple, QUERIES["op13_language_model"](spark, sf_dir).collect()))
    assert [r[:6] for r in rows] == base_rows(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    held = [(r[5], r[6]) for r in rows if r[1]]
    assert sum(s for _, s in held) > 0.95 * sum(b for b, _ in held) and all(r[6] < 0 for r in rows)
    release(spark)


def exact_tables(n, a, d):
    """Chances of the numbers of tables of n customers: a^t times the generalised Stirling numbers."""
    ways = {1: 1.0}
    for j in range(1, n):
        more = Counter()
        for t, x in ways.items():
            more[t] += x * (j - d * t)
            more[t + 1] += x
        ways = more
    weights = np.array([ways[t] * a**t for t in range(1, n + 1)])
    return weights / weights.sum()


@pytest.mark.parametrize("n, a", [(2, 0.3), (5, 0.1), (5, 2.0), (40, 0.5)])
def test_sampler_has_the_models_distribution(n, a):
    rng = np.random.default_rng(8)
    customers, chances = np.full(4000, n), np.full(4000, a)
    state, found = None, np.zeros(n + 1)
    for i in range(400):
        state = pitman_yor._Rows._draw(state, customers, chances, 2, rng)
        if i >= 100:  # many customers take long to forget the first seating
            found += np.bincount(state[1], minlength=n + 1)
    assert np.abs(found[1:] / found.sum() - exact_tables(n, a, pitman_yor.DISCOUNT[2])).max() < 0.03


def test_tables_of_many_customers():
    rng = np.random.default_rng(9)
    tables, _ = seat(np.array([1, 10**9, 2, 10**6]), np.full(4, 1.0), 0.5, rng)
    assert tables[0] == 1 and tables[2] in (1, 2)
    # near the logarithm of their number, as the harmonic sum of the chances
    assert 6 < tables[3] < 30 and 10 < tables[1] < 40


def test_probabilities_add_up(spark):
    texts = ["a b c a b a", "a b", "c c c a", "", "d a b e"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}

    class Kept(pitman_yor.Shares):
        def __init__(self, *args):
            super().__init__(*args)
            seen["shares"] = self

    before, pitman_yor.Shares = pitman_yor.Shares, Kept
    try:
        rows = language_model_scores(docs, F.lit(True)).collect()
    finally:
        pitman_yor.Shares = before
    # each text of one word: the chance of the word and then the end
    shares = seen["shares"]
    assert (shares.rest >= 0).all() and (shares.rest <= 1).all()
    by_text = {t: 10 ** rows[i]["score"] for i, t in enumerate(texts)} if rows else {}
    assert len(by_text) == 5 and 0 < by_text["a b"] < by_text[""] <= 1
    release(spark)


def test_chances_of_all_words_are_one():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    places = rng.choice(pitman_yor.N_LEAVES, 5, replace=False).astype(np.uint16)
    leaves = [np.sort(rng.choice(places, rng.integers(1, 6), replace=False)) for _ in words]
    counts = [rng.integers(1, 50, len(x)).astype(np.int64) for x in leaves]
    lot = pa.table({"word": words, "leaves": [x.tobytes() for x in leaves], "counts": [x.tobytes() for x in counts]})
    batches = lot.to_batches()

    def totals(found):
        both = np.zeros((2, pitman_yor._SLOTS))
        for b in found:
            both[:, b.column("slot").to_numpy()] += [b.column("customers").to_numpy(), b.column("tables").to_numpy()]
        levels = [[x[0], x[1:257], x[257:]] for x in both]
        return pitman_yor.Totals(*levels, len(words))

    first = totals(pitman_yor._add_up(None, 0)(iter(batches)))
    second = totals(pitman_yor._add_up(first, 1)(iter(batches)))
    model = list(pitman_yor._learn(second, 2)(iter(batches)))
    own = np.zeros(pitman_yor._SLOTS)
    for b in pitman_yor._own_sums(iter(model)):
        own[b.column("slot").to_numpy()] += b.column("own").to_numpy()
    shares = pitman_yor.Shares(second, own)
    asked = np.append(places, np.uint16(77)).astype(np.uint16)
    known = pa.Table.from_batches(model).append_column("asked", pa.array([asked.tobytes()] * len(words)))
    unknown = pa.table({f.name: pa.array([None], f.type) for f in known.schema if f.name != "asked"})
    lot = pa.concat_tables([known, unknown.append_column("asked", pa.array([asked.tobytes()]))])
    chances = shares.probabilities(lot.combine_chunks())[0].reshape(31, -1).sum(axis=0)
    assert chances == pytest.approx(np.ones(6), abs=1e-5)


def test_held_out_texts_beside_copies(spark):
    """Restaurants of copies leave something to words they have not met."""
    page = " ".join(f"w{i}" for i in range(100))
    train = ["la la la la"] * 500 + [page] * 500 + [""] * 500
    held = ["la zo", "zo la", "a", "", f"{page} la", "w7 w3 w90 zo"]
    docs = spark.createDataFrame(list(enumerate(train + held)), "doc_id long, text string")
    rows = language_model_scores(docs, F.col("doc_id") < len(train)).where("held_out").collect()
    assert len(rows) == len(held) and all(math.isfinite(r["score"]) for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    release(spark)


def test_odd_rows(spark, odd_docs, no_docs):
    long = [(100, "La la " * 200_000), (101, " ".join(map(str, range(100_000))))]
    docs = odd_docs.unionByName(spark.createDataFrame(long, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.selectExpr("*", "1 AS train", "2 AS slice", "3 AS word", "4 AS held_out")
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for condition, train in ((F.col("doc_id") % 2 == 0, lambda d: d is not None and d % 2 == 0), (F.lit(False), lambda d: False)):
        rows = [tuple(r) for r in language_model_scores(docs, condition).collect()]
        want = base_rows(given, train)
        assert len(rows) == len(want)
        for row, expected in zip(sorted(rows, key=repr), sorted(want, key=lambda r: repr(r[:5]))):
            assert row[:6] == expected and row[6] <= 0
    assert language_model_scores(no_docs, F.lit(True)).collect() == []
    release(spark)


def test_restaurants_share_parents():
    assert restaurant(b"walking") // pitman_yor.LEAVES == restaurant(b"talking") // pitman_yor.LEAVES
    assert len({restaurant(str(i).encode()) for i in range(10**5)}) > 5000

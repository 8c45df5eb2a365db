"""Ranked search against all scores, with ties, repeated rows and few documents."""

import math
import re
from collections import Counter

import pytest
from sojourn.llm.ranked_search import ranked_search
from sojourn.session import release

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def all_scores(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    return scored([(d, c) for d, c in counts if c], items, k, 0)


def scored(counts, items, k, no_id):
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scores.append((-score, d is None, d or no_id, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("k, sizes", [(1, {}), (3, {"shard_rows": 1}), (10, {"block_terms": 40}), (10, {})])
def test_all_scores(spark, odd_docs, k, sizes):
    made = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 2 + i % 40))) for i in range(20, 220)]
    made += [(i, "same words here W5") for i in range(300, 330)] + [(None, "same words here W5")]
    made += [(400, "w1 " * 60_000 + "ß É é end"), (401, "only-one.\x01two")]
    docs = odd_docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.selectExpr("*", "1 AS term", "2 AS query", "3 AS n", "4 AS terms", "5 AS id", "6 AS band")
    asked = [("a", "w1 w2 w3 w22"), ("b", "SAME words"), ("c", None), ("d", "nowhere"), ("e", "é ß w7 w7"), ("f", "w5 " * 9)]
    asked += [("b", "SAME words"), (None, "word two"), ("g", " ".join(f"w{i}" for i in range(23)))]
    asked += [("h", " ".join(f"v{i}" for i in range(150)))]  # many terms in a query
    made += [(500 + i, " ".join(f"v{j}" for j in range(150) if (i * j) % 7 < 3)) for i in range(1, 30)]
    queries = spark.createDataFrame(asked, "item_id string, text string").selectExpr("*", "1 AS id", "2 AS row")
    rows = sorted(map(repr, (tuple(r) for r in ranked_search(docs, queries, "doc_id", "item_id", k, **sizes).collect())))
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows == sorted(map(repr, all_scores(given, asked, k)))
    release(spark)


def test_shards_of_a_task(spark):
    """One task with many shards of one batch: bars of the shards before, ties between them, ids of text."""
    made = [(f"d{i * 7919 % 1000:03}", f"a{i % 3} b{i % 7} c{i % 11} " * (1 + i % 4)) for i in range(1000)]
    docs = spark.createDataFrame(made + [(None, "a0 b0 c0")] * 3, "doc_id string, text string").coalesce(1)
    asked = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(12)]
    queries = spark.createDataFrame(asked, "item_id long, text string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
    try:
        rows = [tuple(r) for r in ranked_search(docs, queries, "doc_id", "item_id", 15, shard_rows=1).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts = [(d, Counter(terms(t))) for d, t in made + [(None, "a0 b0 c0")] * 3]
    assert len(rows) == 12 * 15 and sorted(rows) == sorted(scored(counts, asked, 15, ""))
    release(spark)


def test_nothing_to_find(spark, odd_docs, no_docs):
    queries = spark.createDataFrame([("a", "nowhere"), ("b", "")], "item_id string, text string")
    for docs, asked in ((odd_docs, queries), (no_docs, queries), (odd_docs, queries.limit(0))):
        found = ranked_search(docs, asked, "doc_id", "item_id")
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []
    release(spark)

"""Passages of long benchmark items, and items of few words."""

import random

import pytest

import brute
from sojourn.llm import decontaminate


def test_passages_of_long_items_and_short_items(spark):
    rng = random.Random(31)

    def sentence(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    items = [(0, sentence(200)), (1, sentence(90)), (2, sentence(51)), (10, ["alone"]), (11, ["two", "words"]), (12, ["these", "are", "three"])]
    docs, expected = [], {}
    for item, words in items[:3]:
        for size in (30, 45, 100):
            for at in (0, 13, max(0, len(words) - size)):
                passage = words[at : at + size]
                if len(passage) >= 30:
                    expected[len(docs), item] = None
                docs.append(sentence(25) + passage + sentence(25))
    for text in ("alone", "here alone there", "x two words y", "two x words", "words two", "these are three", "these are not three", "these are"):
        docs.append(text.split())
    n = len(docs)
    for doc_id, item in [(n - 8, 10), (n - 7, 10), (n - 6, 11), (n - 3, 12)]:
        expected[doc_id, item] = None
    for doc_id, item in expected:
        words = dict(items)[item]
        expected[doc_id, item] = pytest.approx(brute.alignment(words, docs[doc_id]) / (2 * len(words)))
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontaminate.contaminated(table, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == expected

"""Edited copies of benchmark items, against brute-force alignment of every item with every document."""

import random

import pytest

import brute
from sojourn.llm import decontaminate


def edited(rng, passage, every, kind):
    out = []
    for i, word in enumerate(passage):
        if (i + 1) % every or kind == "put in":
            out.append(word)
        if (i + 1) % every == 0 and kind != "left out":
            out.append(f"new{rng.randrange(10**6)}")
    return out


@pytest.mark.parametrize("common", [0, 20])
def test_every_copy_with_the_score_is_found(spark, monkeypatch, common):
    monkeypatch.setattr(decontaminate, "HITS", 500)
    rng = random.Random(21 + common)

    def sentence(n):  # with `common`, half of the words are of a few very frequent ones
        return [f"c{rng.randrange(common)}" if common and rng.random() < 0.5 else f"w{rng.randrange(3000)}" for _ in range(n)]

    items, docs = [], []
    for n in [*range(4, 17), 25, 40, 70]:
        items.append((len(items), sentence(n)))
        for every in range(2, 8):
            for kind in ("replaced", "put in", "left out"):
                docs.append(sentence(20) + edited(rng, items[-1][1], every, kind) + sentence(20))
    for item, words in items[:13] * 10:  # two random edits
        copy = list(words)
        for _ in range(2):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["other"], ["other", copy[at]]])
        docs.append(sentence(8) + copy + sentence(8))
    expected = {}
    for doc_id, doc in enumerate(docs):
        for item, words in items:
            score = brute.alignment(words, doc) / (2 * len(words))
            if score >= decontaminate.LEAST_SCORE:
                expected[doc_id, item] = pytest.approx(score)
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontaminate.contaminated(table, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == expected

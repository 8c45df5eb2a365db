"""Words and texts that differ never pass for equal, patterned ones included."""

import brute
import numpy as np
import pyarrow as pa
from sojourn.llm import common
from sojourn.llm.common import word_hashes, words_of
from sojourn.llm.jaccard import similarity_components
from sojourn.llm.repeats import without_repeats
from sojourn.session import release


def thue_morse(bits, a="a", b="b"):
    word = a
    for _ in range(bits):
        word += word.translate(str.maketrans({a: b, b: a}))
    return word


def test_hashes_of_patterned_words():
    words = [thue_morse(n, *ab) for n in range(14) for ab in ("ab", "ba", "xy")]
    words += ["a" * n for n in range(1, 40)] + ["a" * 9 + "b", "b" + "a" * 9, "é" * 5, "é" * 4100, "É" * 4100]
    found = word_hashes(words_of(pa.array([" ".join(words)])))
    assert len(set(found.tolist())) == len(set(words))
    # the place in a text doesn't matter
    again = word_hashes(words_of(pa.array(["", "other words " + " ".join(words[::-1])])))
    assert again[2:][::-1].tolist() == found.tolist()


def test_folding(monkeypatch):
    texts = pa.array(["Abc ABCDEFGHIJ É", "aBC abcdefghij é"])
    a = word_hashes(words_of(texts), fold=True)
    assert a[:2].tolist() == a[3:5].tolist() and a[2] != a[5]
    monkeypatch.setattr(common, "LONG_WORD", 4)
    b = word_hashes(words_of(texts), fold=True)
    assert b[:2].tolist() == b[3:5].tolist() and len(np.unique(b)) == 4


def test_patterned_words_are_not_taken_for_equal(spark):
    word, other = thue_morse(10), thue_morse(10, "b", "a")
    texts = {1: word, 2: other, 3: " ".join([word] * 40), 4: " ".join([other] * 34 + ["end"]), 5: f"{word} x y", 6: f"{other} x y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity_components(docs, 3, 90).collect()}
    assert rows == brute.components(texts, 3, 90) and rows[1][1] != rows[2][1]
    kept = {r["doc_id"]: r["n_removed"] for r in without_repeats(docs, window=35).collect()}
    assert kept == {d: removed for d, _, removed, _ in brute.without_repeats(list(texts.items()), 35)}
    release(spark)

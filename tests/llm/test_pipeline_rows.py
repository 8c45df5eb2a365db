"""Stages of the pipeline on rows without labels, with repeated ids and without ids."""

import os
import random

import corpus_pipeline
from sojourn.llm import jaccard
from sojourn.session import release, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


def _frame(spark, rows, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t in rows], SCHEMA)


def test_without_labels_only_rows_without_a_letter_go(spark, sf_dir):
    rows = [(1, "some words"), (2, "12 34"), (3, None), (4, ""), (5, "ñ"), (None, "no id")]
    kept = corpus_pipeline.known_language(spark, _frame(spark, rows), sf_dir)
    assert _rows(kept) == sorted([rows[0], rows[4], rows[5]], key=str)


def test_near_copies_are_judged_row_by_row(spark, sf_dir):
    rng = random.Random(41)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (3, a + " again"), (None, a), (None, c), (None, c), (4, d), (5, None), (5, None), (6, e), (None, e)]
    kept = corpus_pipeline.one_of_near_copies(spark, _frame(spark, rows), sf_dir)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert _rows(kept) == sorted([(1, a), (3, b), (None, c), (4, d), (5, None), (5, None), (6, e)], key=str)


def test_contaminated_rows_go_whatever_their_id(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text IS NOT NULL").first()["text"]
    rows = [(1, "a clean text"), (1, f"it begins {item} and ends"), (None, item), (None, "clean as well"), (2, "clean"), (2, "clean")]
    kept = corpus_pipeline.without_benchmark(spark, _frame(spark, rows), sf_dir)
    assert _rows(kept) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


def test_few_texts_are_shuffled_to_look_rows_up(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, "no id"), (7, None)]
    named = _frame(spark, rows).select("*", *corpus_pipeline._row())
    wanted = named.where("doc_id < 20 OR doc_id IS NULL OR text IS NULL").select("_row", "_check")
    found = {(r["doc_id"], r["text"]): r["_listed"] for r in corpus_pipeline._listed(named, wanted).collect()}
    assert len(found) == len(rows) and sum(found.values()) <= 22 + 20
    assert all(found[i, t] for i, t in rows if i is None or i < 20 or t is None)
    assert not any(r["_listed"] for r in corpus_pipeline._listed(named, wanted.limit(0)).collect())


def test_prefixes_are_stored_once_for_each_set(spark, monkeypatch):
    kept = []

    def lists(nodes, percent, parts, before=jaccard._lists):
        tables = [p for p in os.listdir(shared_dir(spark).removeprefix("file://")) if p.startswith("sojourn-")]
        frames = [spark.read.parquet(f"{shared_dir(spark)}/{p}") for p in tables]
        kept.extend(df.count() for df in frames if "prefix" in df.columns)
        return before(nodes, percent, parts)

    monkeypatch.setattr(jaccard, "_lists", lists)
    docs = spark.createDataFrame([(i, f"some words {min(i, 3)} that are the same") for i in range(40)], "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_components(docs, 3, 90).collect()}
    assert kept == [4] and rows == {i: min(i, 3) for i in range(40)}
    release(spark)

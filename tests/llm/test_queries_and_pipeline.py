"""The registered queries against their SQL or their plain versions, and the pipeline stage by stage."""

import hashlib

import public_tokenizers
import pytest
from compare import connect, duck_rows, spark_rows
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
import corpus_pipeline
from sojourn.llm.queries import ORACLES, QUERIES
from sojourn.session import release


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))


def test_each_operator_has_its_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(connect(sf_dir), ORACLES[name])
    release(spark)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_all_documents(spark, sf_dir, texts, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()]
    if name.split("_")[0] in ("op2", "op7", "op9"):
        assert 0 < len(ids) < len(texts)  # findings
    else:
        assert sorted(ids) == sorted(texts)
    release(spark)


def test_op3_op4_op5_match_plain_versions(spark, sf_dir, texts):
    rows = sorted(map(tuple, QUERIES["op3_substring_dedup"](spark, sf_dir).collect()))
    assert rows == brute.without_repeats(sorted(texts.items()), 35)
    rows = sorted(map(tuple, QUERIES["op4_token_ids"](spark, sf_dir).collect()))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert rows == brute.token_rows(sorted(texts.items()), tokenizer, 2)
    rows = {r[0]: tuple(r)[1:] for r in QUERIES["op5_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert rows == brute.components(texts, 3, 90)
    release(spark)


def test_op8_edits_the_last_half(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        assert rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_pipeline_stages(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "mixture", "token_ids"]
    kept = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        found = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            kept = {d: t for d, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_copies":
            groups = brute.components(kept, corpus_pipeline.NEAR_WIDTH, corpus_pipeline.NEAR_PERCENT)
            kept = {d: t for d, t in kept.items() if groups[d][1] == d}
        else:
            gone = {r["doc_id"] for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
            kept = {d: t for d, t in kept.items() if d not in gone}
        assert found == kept
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert {d for d, _ in rows} <= set(kept) and mixed.columns == docs.columns
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert sorted(map(tuple, ids.collect())) == sorted(brute.token_rows(sorted(rows), tokenizer, corpus_pipeline.END_ID))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, ids.collect()))
    release(spark)


def test_pipeline_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for given in (odd_docs, no_docs):
        docs = given.select("doc_id", "text", "lang", "source", "n_chars")
        left = {}
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            left[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
        if given is no_docs:
            assert not any(left.values())
            continue
        texts = {(r["doc_id"] is None, r["doc_id"] or 0): r["text"] for r in odd_docs.collect()}
        with_letters = {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
        assert set(left["language"]) == with_letters and len(left["language"]) == len(with_letters) + 1  # 3 is there twice
        assert left["near_copies"] == sorted(with_letters)
        assert set(left["decontamination"]) <= with_letters and set(left["mixture"]) <= set(left["decontamination"])
        assert left["decontamination"] and left["token_ids"] == left["mixture"]
    release(spark)

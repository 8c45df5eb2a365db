"""Each operator against its plain version, and on null, empty, long, repeated and missing rows."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from sojourn.llm import decontaminate, fingerprint, idstream, jaccard, language, licenses, mixture, pseudonyms, quality, repeats
from sojourn.session import release

VOCABULARY = [f"w{i}" for i in range(3000)]
PATH = public_tokenizers.path("word_bpe_49k.json")


def sentence(rng, n, words=VOCABULARY):
    return [rng.choice(words) for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(list(docs), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def near_copies():
    """Groups of copies with one to thirty edits, chains of edits, frequent passages, and plain texts."""
    rng = random.Random(11)
    docs, common = {}, sentence(rng, 40)
    for _ in range(6):
        base = sentence(rng, rng.randint(30, 200))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 30])):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            docs[len(docs) + 10] = " ".join(copy).title() if rng.random() < 0.3 else " ".join(copy)
    chain = sentence(rng, 120)
    for _ in range(20):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = rng.choice(VOCABULARY)
        docs[len(docs) + 10] = " ".join(chain)
    for _ in range(40):
        docs[len(docs) + 10] = " ".join(sentence(rng, rng.randint(1, 60)) + common * rng.randint(0, 1))
    docs |= {1: None, 2: "", 3: "a b", 4: "A  B", 5: "a", 6: "a a a a", 7: "a a a"}
    return docs


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_components_match_all_pairs(spark, near_copies, width, percent):
    found = jaccard.similarity_components(frame(spark, near_copies.items()), width, percent).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == brute.components(near_copies, width, percent)
    release(spark)


def test_components_of_odd_rows(spark, odd_docs, no_docs):
    found = jaccard.similarity_components(odd_docs, 3, 90).collect()
    assert len(found) == odd_docs.count() and Counter(r["doc_id"] for r in found)[3] == 2
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}
    assert jaccard.similarity_components(no_docs, 3, 90).count() == 0


@pytest.mark.parametrize("window", [16, 35])
def test_repeats_match_counting_all_windows(spark, window):
    rng = random.Random(12)
    shared = [sentence(rng, n) for n in (34, 35, 36, 60, 200)]
    docs = [(i, " ".join(sentence(rng, rng.randint(0, 80)))) for i in range(30)]
    for i in range(30, 90):
        parts = [w for _ in range(rng.randint(1, 4)) for w in rng.choice(shared)[rng.randint(0, 9) :] + sentence(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(len(parts))] = "edit"
        docs.append((i, "\n".join(parts)))
    docs += [(90, "same " * 100), (91, "one two " * 60), (92, None), (93, ""), (94, docs[5][1]), (95, "same " * 36), (96, "é ü " * 40)]
    found = repeats.without_repeats(frame(spark, docs), window)
    found = found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, found)) == brute.without_repeats(docs, window)
    release(spark)


def test_repeats_of_odd_rows(spark, odd_docs, no_docs):
    rows = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.without_repeats(odd_docs).collect()}
    assert (0, 0, 0) in rows and (None, 2, 0) in rows and (8, 2400, 2400) in rows
    assert repeats.without_repeats(no_docs).count() == 0
    # a row that occurs twice repeats itself
    twice = frame(spark, [(1, " ".join(VOCABULARY[:40]))] * 2 + [(2, "x")])
    assert sorted(tuple(r)[:3] for r in repeats.without_repeats(twice).collect()) == [(1, 40, 40), (1, 40, 40), (2, 1, 0)]
    with pytest.raises(ValueError):
        repeats.without_repeats(no_docs, window=200)


def test_token_files_hold_every_id(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(13)
    docs = [(i, " ".join(sentence(rng, rng.randint(0, 50)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " ".join(sentence(rng, 60_000))), (1003, "It's <|endoftext|> İ'll ΑΣ ñ́ don't! 12;x")]
    found = idstream.encoded_documents(frame(spark, docs), PATH, 2, str(tmp_path / "ids")).collect()
    assert sorted(map(tuple, found)) == brute.token_rows(docs, Tokenizer.from_file(PATH), 2)
    again = idstream.read_ids(spark.read.parquet(str(tmp_path / "ids")))
    assert again.count() == len(docs)
    rows = idstream.encoded_documents(odd_docs, PATH, 2).collect()
    assert len(rows) == odd_docs.count() and rows and min(r["start"] for r in rows) == 0
    assert idstream.encoded_documents(no_docs, PATH, 2).count() == 0


def test_language_is_found_and_unknown_is_told(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify_language(docs, docs, keep=["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    odd = {r["doc_id"]: r for r in language.identify_language(odd_docs, docs, keep=["doc_id"]).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 7)] == ["und"] * 4 and odd[0]["score"] == 0
    assert odd[3]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in odd.values())
    nothing = language.identify_language(odd_docs, no_docs, keep=["doc_id"]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.identify_language(no_docs, docs).count() == 0


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat(concat(id, ' text '), 300) AS text", "if(id % 3 = 0, 'a', concat('l', id % 5)) AS lang")
    sample = language.language_sample(docs)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == dict.fromkeys(
        ["a", "l0", "l1", "l2", "l3", "l4"], language.SAMPLE_TEXTS
    )
    assert sample.agg(F.max(F.length("piece"))).first()[0] == language.PIECE_CHARS


def test_contaminated_passages(spark, odd_docs, no_docs):
    rng = random.Random(14)
    items = [(i, " ".join(sentence(rng, rng.randint(12, 60)))) for i in range(12)]
    docs, expected = [(i, " ".join(sentence(rng, 150))) for i in range(40)], set()
    for i, (item, text) in enumerate(items * 3):
        passage = text.split()
        for _ in range(len(passage) // 12 * (i // 12)):  # exact, and two rates of edits
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], ["edited"], ["put", "in"]])
        docs.append((100 + i, " ".join(sentence(rng, 30) + passage + sentence(rng, 30)).upper() + "!"))
        expected.add((100 + i, item))
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame(spark, docs), benchmark).collect()}
    assert set(found) == expected
    for (doc_id, item), r in found.items():
        plain = brute.alignment(dict(items)[item].split(), dict(docs)[doc_id].lower().strip("!").split())
        assert r["score"] == pytest.approx(plain / (2 * len(dict(items)[item].split())))
    assert decontaminate.contaminated(odd_docs, benchmark).count() == 0
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0
    assert decontaminate.contaminated(odd_docs, benchmark.limit(0)).count() == 0


def test_benchmark_in_blocks_gives_the_same(spark, sf_dir, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 9)
    assert whole and sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == whole


def test_licenses(spark, odd_docs, no_docs):
    rng = random.Random(15)
    docs = []
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        docs.append((i, " ".join(sentence(rng, 3 * i)) + "\n" + text.lower() + ".\n" + " ".join(sentence(rng, 50))))
    found = {(r["doc_id"], r["template"]) for r in licenses.license_notices(frame(spark, docs)).collect()}
    assert found >= set(enumerate(licenses.TEMPLATES)) and len(found) == len(docs) + 1  # the Apache header holds the line
    assert licenses.license_notices(odd_docs).count() == licenses.license_notices(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.license_notices(odd_docs, {"short": "two words"})


def test_mixture_meets_its_targets(spark, odd_docs, no_docs):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 3 > 0, 'big', if(id % 9 = 0, null, 'small')) AS source", "7 AS rate")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 2.0), ("absent", 5.0)], "source string, weight double")
    got = mixture.mix_sources(docs, weights)
    assert got.columns == docs.columns
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    for source, target in (("big", 1500), ("small", 1500), (None, 3000)):
        assert abs(counts[source] - target) < 5 * math.sqrt(target)
    repeats_of = Counter(r["doc_id"] for r in got.where("source IS NULL").collect())
    rate = 3000 / docs.where("source IS NULL").count()
    share_of_none = 1 - len(repeats_of) / docs.where("source IS NULL").count()
    assert share_of_none == pytest.approx(math.exp(-rate), abs=0.03)
    assert sorted(map(tuple, mixture.mix_sources(docs, weights).collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    assert mixture.mix_sources(docs, weights.limit(0)).count() == 0 and mixture.mix_sources(no_docs).count() == 0
    names = ["_draw", "_copy", "_order", "_source", "_steps", "row", "steps", "draw", "content", "copies", "order", "name"]
    clashing = odd_docs.selectExpr("*", *(f"{i} AS {n}" for i, n in enumerate(names) if n not in odd_docs.columns))
    got = mixture.mix_sources(clashing)
    assert got.columns == clashing.columns and got.count() > 0 and got.distinct().exceptAll(clashing.distinct()).count() == 0
    assert got.select("_draw", "_source", "steps").distinct().collect() == clashing.select("_draw", "_source", "steps").distinct().collect()


def test_mixture_spreads_rows_without_an_id(spark):
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "string(id) AS text", "'s' AS source")
    copies = docs.selectExpr("7L AS doc_id", "text", "source")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for given in (docs, copies):
        got = mixture.mix_sources(given, temperature=1.0)
        drawn = [mixture.uniform(mixture.SEED).alias("draw")]
        assert given.select(*drawn).distinct().count() == (6001 if given is docs else 1)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 0 or max(sizes) < 1.3 * sum(sizes) / len(sizes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_poisson_steps_also_for_large_rates(spark):
    rates = [("none", 0.0), ("a", 0.3), (None, 5.0), ("b", 2000.0), ("c", 100_000.0)]
    rows = mixture.poisson_steps(spark.createDataFrame(rates, "source string, rate double")).collect()
    found = {source: np.array(steps) for source, steps in rows}
    assert found.keys() == {"a", None, "b", "c"}
    for source, rate in rates[1:]:
        steps, k = found[source], np.arange(len(found[source]))
        log_p = k * math.log(rate) - rate - np.array([math.lgamma(i + 1) for i in k])
        assert len(steps) > rate and np.allclose(steps, np.exp(log_p).cumsum(), atol=1e-7)


def test_fingerprints_tell_equality_and_locate_edits(spark, odd_docs, no_docs):
    docs = frame(spark, [(1, "One. Two!\nThree\n\nFour"), (2, "One. Two!\nThree\n\nFour"), (3, "One. Two!\nThree,\n\nFour"), (4, None), (5, "")])
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert found[1] == found[2] != found[3] and found[4] == found[5]
    nodes = fingerprint.paragraph_nodes(fingerprint.tree(F.col("text")))
    pair = docs.where("doc_id IN (1, 3)").agg(F.min_by(nodes, "doc_id").alias("a"), F.max_by(nodes, "doc_id").alias("b"))
    assert pair.select(fingerprint.edited_paragraphs(F.col("a"), F.col("b"))).first()[0] == [(0, 1)]
    assert fingerprint.edited_fingerprints(no_docs).count() == 0
    odd = fingerprint.edited_fingerprints(odd_docs).collect()
    assert len(odd) == odd_docs.select("doc_id", "text").distinct().count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in odd)


def test_likeness_follows_the_share_that_is_kept(spark, sf_dir):
    rows = fingerprint.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    edited, after = (sum(r[c] for r in rows) / len(rows) for c in ("near_edited", "near_next"))
    assert 0.35 < edited < 0.75 and after < 0.1


def test_pseudonyms_replace_only_what_is_valid(spark, odd_docs, no_docs):
    text = "Call +1 (555) 010-9999 or 192.168.0.12, card 4111111111111111, not 4111111111111112."
    found = {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame(spark, [(1, text), (2, "none 1 2 3"), (3, text)]), b"k").collect()}
    assert set(found) == {1, 3} and found[1]["text"] == found[3]["text"]
    assert [f["kind"] for f in found[1]["found"]] == ["phone", "address", "card"]
    assert "4111111111111112" in found[1]["text"] and "010-9999" not in found[1]["text"]
    assert pseudonyms.pseudonymise(odd_docs, b"k").count() == pseudonyms.pseudonymise(no_docs, b"k").count() == 0


def test_quality_is_learned_from_other_folds(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = quality.train(docs, labels.where(~held_out))
    scored = quality.quality_scores(docs, machine).join(labels.where(held_out), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) > 0.9 * len(scored) > 50
    assert [r["score"] for r in quality.quality_scores(docs, quality.train(docs, labels.where(~held_out))).limit(5).collect()] == [
        r["score"] for r in quality.quality_scores(docs, machine).limit(5).collect()
    ]
    odd = quality.quality_scores(odd_docs.drop("score"), machine).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    untrained = quality.train(no_docs, labels.limit(0))
    assert quality.quality_scores(no_docs.drop("score"), untrained).count() == 0

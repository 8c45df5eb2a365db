"""The registered queries of the document operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.common import documents, id_remainder
from sojourn.llm.decontaminate import contaminated
from sojourn.llm.fingerprint import SQL as FINGERPRINT_SQL
from sojourn.llm.fingerprint import edited_fingerprints
from sojourn.llm.idstream import encoded_documents
from sojourn.llm.jaccard import similarity_components
from sojourn.llm.language import identify_language
from sojourn.llm.licenses import license_notices
from sojourn.llm.mixture import SEED, TEMPERATURE, mix_sources
from sojourn.llm.periods import looped, periodic_runs, run_digests
from sojourn.llm.pitman_yor import language_model_scores
from sojourn.llm.pseudonyms import pseudonymise
from sojourn.llm.quality import quality_scores, train
from sojourn.llm.ranked_search import SQL as SEARCH_SQL
from sojourn.llm.ranked_search import ranked_search
from sojourn.llm.repeats import without_repeats

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labels of the other folds."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 4) == 2
    return identify_language(
        docs.withColumn("held_out", held_out), docs.where(~held_out), keep=("doc_id", "held_out")
    )


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_notices(documents(spark, sf_dir))


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of any 35-word window that occurs twice."""
    kept = without_repeats(documents(spark, sf_dir), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to compressed blocks and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return encoded_documents(documents(spark, sf_dir), path, end_id=2)


@query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of word trigrams are similar to 0.9."""
    return similarity_components(documents(spark, sf_dir), width=3, percent=90)


@query(f"""
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*), {TEMPERATURE}) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
steps AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k)),
draws AS (SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
  / 4503599627370496.0 AS draw FROM documents)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars
FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.p <= d.draw""")
def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each source repeated to its target weight, in random order."""
    return mix_sources(documents(spark, sf_dir))


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies of benchmark items, edited ones included."""
    docs = documents(spark, sf_dir)
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(FINGERPRINT_SQL)
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of an edited text, and their likeness."""
    return edited_fingerprints(documents(spark, sf_dir))


@query()
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data, each value replaced by its pseudonym. Real use brings its own secret key."""
    return pseudonymise(documents(spark, sf_dir), key=b"key of the registered query")


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of the other folds."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return quality_scores(docs.withColumn("held_out", held_out), train(docs, labels), keep=("doc_id", "held_out"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of which are made to repeat, and digests of what is left."""
    return run_digests(periodic_runs(looped(documents(spark, sf_dir))))


@query(SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(documents(spark, sf_dir), items, "doc_id", "item_id")


@query()
def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a Pitman-Yor model of the other folds, and by word counts."""
    return language_model_scores(documents(spark, sf_dir), id_remainder("doc_id", 7) != 2)

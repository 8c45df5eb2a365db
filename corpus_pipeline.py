"""A corpus pipeline: language ID, near copies, benchmark passages, mixture of sources, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run` writes what a stage
returns as Parquet in the shared folder and gives the next stage the table as it was read again.
"""

from __future__ import annotations

from contextlib import ExitStack

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.common import documents, prepare
from sojourn.llm.decontaminate import contaminated
from sojourn.llm.idstream import encoded_documents
from sojourn.llm.jaccard import similarity_components
from sojourn.llm.language import UNDETERMINED, identify_language
from sojourn.llm.mixture import mix_sources
from sojourn.session import stored, write_once

#: Near copies share so much of their sets of word 5-grams.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Bits of the table that tells which rows may be among some, as a power of two: 1 MB, whatever the input.
LISTED_BITS = 23


def _row() -> tuple[Column, Column]:
    """Two hashes of id and text, which stand for a row: rows may share an id or have none."""
    return F.xxhash64("doc_id", "text").alias("_row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_check")


def _listed(named: DataFrame, rows: DataFrame) -> DataFrame:
    """`named` with `_listed`: whether a row may be among `rows`, by a table of bits; only such texts need a join."""
    bit = f"_row & {(1 << LISTED_BITS) - 1}"
    word, mask = f"shiftright({bit}, 6) AS _word", "shiftleft(1L, CAST(_row & 63 AS INT))"
    bits = rows.selectExpr(word, f"{mask} AS _mask").groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    found = named.selectExpr("*", word).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("_listed", F.expr(f"coalesce(_bits & {mask}, 0L) <> 0")).drop("_word", "_bits")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know, or in any if there are no labels; those without a letter go.

    `lang` keeps its labels.
    """
    found = identify_language(docs, docs, keep=docs.columns)
    return found.where((F.col("lang_pred") != UNDETERMINED) | F.col("text").rlike(r"\p{L}")).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id; ids that are null come last.

    Of rows with the same id and text one stays, and of different texts under one id the one with the least hash,
    if they are near copies. Rows without any word are copies of nothing.
    """
    by_row = docs.select(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", *_row()).alias("doc_id"), "text")
    groups = similarity_components(by_row, NEAR_WIDTH, NEAR_PERCENT).where("n_shingles > 0")
    rows = groups.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id._row", "doc_id._check", F.expr("component_id <> doc_id").alias("gone"), "n")
    rows = write_once(rows.where("gone OR n > 1"))
    named = _listed(docs.select("*", *_row()), rows)
    some = named.where("_listed")
    kept = named.where("NOT _listed").select(*docs.columns)
    kept = kept.union(some.join(rows, ["_row", "_check"], "left_anti").select(*docs.columns))
    repeated = rows.where("NOT gone")
    if repeated.isEmpty():
        return kept
    repeated = some.join(repeated, ["_row", "_check"], "left_semi").groupBy("_row", "_check")
    return kept.union(repeated.agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; each row is judged by its own text."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs.select(F.struct(*_row()).alias("doc_id"), "text"), benchmark)
    gone = write_once(found.select("doc_id._row", "doc_id._check").distinct())
    return docs.select("*", *_row()).join(gone, ["_row", "_check"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by the draw of their source, in random order."""
    return mix_sources(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    return encoded_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixture", mixed),
    ("token_ids", token_ids),
]

#: SQL cannot express the stages; the tests compare each of them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes when its successor's is written."""
    docs, before = documents(spark, sf_dir), ExitStack()
    for _, stage in STAGES[:-1]:
        with before:
            before = ExitStack()
            docs = before.enter_context(stored(stage(spark, docs, sf_dir)))
    with before:  # the ids are in files of their own by then
        return STAGES[-1][1](spark, docs, sf_dir)

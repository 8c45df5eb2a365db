"""Ranked lexical search without random access: impact-sorted reads with bounds for every document.

Documents are searched in shards of bounded size. A shard holds the postings of its documents for the terms that a query
can use, with their impacts: what a term adds to the document's score. Its lists are sorted by impact and read for each
query from the top down, an octave of impacts in a round. After a round the lists' frontiers are known: the most that a
posting not read yet can add. A document has the sum of its read impacts as lower bound, and that plus the frontiers of
the lists it was not seen in as upper bound. As a read impact is never below its list's frontier, no upper bound is below
the sum of the frontiers; once that sum is below the k-th best lower bound, unseen documents are out, and seen ones go as
soon as their upper bound is below it too. Reading goes on until no bound is open: membership, ties and scores are exact.

A task keeps the k best of each query and starts its next shard with the bar they set. Weights come from counts over all
documents, so the best of all tasks are the best of all. Queries go to the tasks in blocks of bounded size, whose terms
and weights are the only thing sent there; each block reads the term counts once. Nothing is made for a pair of query and
document outside a shard's arrays.

Scores are whole numbers of 64 bits. A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact in a document
weight * (10^9 tf div (1000 tf + 8 m)) with m = 10 + (90 n N) div L.

Null and empty texts have no terms; they are not counted in N and match nothing. Queries without terms have no rows.
Repeated rows are documents (or queries) of their own, also under one id or none; equal scores are ordered by id, null
last. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending
from sojourn.llm.common import prepare
from sojourn.session import scratch_path, shuffles_removed, write_once

#: What parts terms: ASCII that is no letter or digit.
PARTS = bytes(b for b in range(0x80) if not chr(b).isalnum())
_FOLD = bytes.maketrans(PARTS + bytes(range(0x41, 0x5B)), b" " * len(PARTS) + bytes(range(0x61, 0x7B)))
#: Bits of the filter of query terms that go to the workers; terms that share a bit are told apart in the shards.
FILTER_BITS = 1 << 22
#: Documents and postings of a shard; a document's postings are never parted.
SHARD_ROWS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Terms of the queries in a block, on average; a query's terms are never parted.
BLOCK_TERMS = 1 << 17
#: Octaves an impact can have.
OCTAVES = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split(b" ") if text else []


def _counted(text: str | None) -> Counter:
    counts = Counter(terms_of(text))
    del counts[b""]
    return counts


def _count_terms(wanted: np.ndarray | None):
    """Length of each text and the counts of its terms, or of those that the filter lets through."""
    bits = None if wanted is None else wanted.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, times = [], [], []
            for text in batch.column("text").to_pylist():
                counts = _counted(text)
                lengths.append(sum(counts.values()))
                kept = [t for t in counts if bits is None or bits[(i := crc32(t) % FILTER_BITS) >> 3] >> (i & 7) & 1]
                terms.append([t.decode() for t in kept])
                times.append([counts[t] for t in kept])
            arrays = [
                batch.column("id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.string())),
                pa.array(times, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "times"])

    return count


def _counts(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """`(id, n, terms, times)` of the rows that have terms."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, terms array<string>, times array<long>"
    return rows.mapInArrow(_count_terms(wanted), schema).where("n > 0")


def _term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each query term, FILTER_BITS at most whatever the number of queries."""
    bits = np.zeros(FILTER_BITS, bool)
    used = terms.select((F.crc32(F.col("term").cast("binary")) % FILTER_BITS).alias("bit")).distinct().toArrow()
    bits[used.column("bit").to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def _weights(counted: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """`(term, weight)` of the terms that add to a score."""
    lists = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return lists.join(terms, "term", "left_semi").select("term", weight.alias("weight")).where("weight > 0")


@dataclass
class Block:
    """Queries of a block: query i, numbered ids[i], has the lists lists[first[i]:first[i + 1]]."""

    terms: pa.Array
    weights: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    lists: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Block:
        """From `(query, term, weight)`."""
        rows = rows.sort_by("query")
        coded = rows.column("term").combine_chunks().dictionary_encode()
        lists = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weights = np.zeros(len(coded.dictionary), np.int64)
        weights[lists] = rows.column("weight").to_numpy()
        ids, first = np.unique(rows.column("query").to_numpy(), return_index=True)
        return Block(coded.dictionary, weights, ids, np.append(first, len(lists)), lists)


@dataclass
class Shard:
    """Postings sorted by list and falling impact; list i has octave OCTAVES - j from cuts[i * OCTAVES + j] on.

    Documents are numbered in the order of their ids, so that the lower of two numbers wins a tie.
    """

    order: pa.Array
    docs: np.ndarray
    impacts: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(rows: pa.Table, block: Block) -> Shard:
        order = pc.sort_indices(rows.column("id"), null_placement="at_end")
        place = np.empty(rows.num_rows, np.int64)
        place[order.to_numpy()] = np.arange(rows.num_rows)
        terms = rows.column("terms").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        lists = pc.fill_null(pc.index_in(terms.flatten(), value_set=block.terms), -1).to_numpy(zero_copy_only=False)
        times = rows.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        known = np.flatnonzero(lists >= 0)
        row, lists, times = row[known], lists[known].astype(np.int64), times[known]
        m = rows.column("m").to_numpy()
        impacts = block.weights[lists] * (10**9 * times // (1000 * times + 8 * m[row]))
        kept = np.flatnonzero(impacts > 0)
        by_impact = kept[np.lexsort((-impacts[kept], lists[kept]))]
        lists, impacts = lists[by_impact], impacts[by_impact]
        octave = np.frexp(impacts.astype(np.float64))[1].astype(np.int64)
        cells = np.arange(len(block.terms) * OCTAVES + 1)
        cuts = np.searchsorted(lists * OCTAVES + (OCTAVES - octave), cells)
        return Shard(order, place[row[by_impact]], impacts, cuts)

    def best(self, lists: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents that reach the bar."""
        cell, ends = lists * OCTAVES, self.cuts[(lists + 1) * OCTAVES]
        n = len(self.order)
        lower, alive, closed = np.zeros(n, np.int64), np.ones(n, bool), False
        seen_docs, seen_lists = [], []
        if self._ahead(self.cuts[cell], ends).sum() < max(bar, 1):  # not even a document in all lists reaches it
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j in range(OCTAVES):
            begin, end = self.cuts[cell + j], self.cuts[cell + j + 1]
            size = end - begin
            if not size.any():
                continue
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            docs, impacts, which = self.docs[at], self.impacts[at], np.repeat(np.arange(len(lists)), size)
            if closed:
                left = alive[docs]
                docs, impacts, which = docs[left], impacts[left], which[left]
            np.add.at(lower, docs, impacts)
            seen_docs.append(docs)
            seen_lists.append(which)
            ahead = self._ahead(end, ends)
            most = int(ahead.sum())
            if n >= k:
                bar = max(bar, int(np.partition(lower, n - k)[n - k]))
            if most >= bar:  # no upper bound is below the bar
                continue
            docs, which = np.concatenate(seen_docs), np.concatenate(seen_lists)
            upper = lower + most
            np.subtract.at(upper, docs, ahead[which])
            alive &= (lower > 0) & (upper >= bar)
            closed = True
            left = alive[docs]
            seen_docs, seen_lists = [docs[left]], [which[left]]
            if not (upper > lower)[alive].any():
                break
        found = np.flatnonzero(alive & (lower >= max(bar, 1)))
        found = found[np.lexsort((found, -lower[found]))[:k]]
        return found, lower[found]

    def _ahead(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The frontiers: the impact at each place, 0 at a list's end."""
        ahead = np.zeros(len(at), np.int64)
        more = at < ends
        ahead[more] = self.impacts[at[more]]
        return ahead


def _shards(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if rows >= most_rows or postings >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held)
            held, rows, postings = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _k_best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, in the order of queries."""
    keys = [("query", "ascending"), ("score", "descending"), ("id", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_end"))
    query = found.column("query").to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def _search(block: Block, k: int, shard_rows: int):
    """The k best documents of a task for each query of the block: `(query, score, id)`."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for rows in _shards(batches, shard_rows):
            shard = Shard.of(rows, block)
            bars = np.zeros(len(block.ids), np.int64)
            if best is not None:
                query = np.searchsorted(block.ids, best.column("query").to_numpy())
                full = np.flatnonzero(np.bincount(query, minlength=len(bars)) >= k)
                last = np.searchsorted(query, full, side="right") - 1
                bars[full] = best.column("score").to_numpy()[last]
            docs, scores, queries = [], [], []
            for i in range(len(bars)):
                found, score = shard.best(block.lists[block.first[i] : block.first[i + 1]], k, int(bars[i]))
                docs.append(found)
                scores.append(score)
                queries.append(np.full(len(found), block.ids[i]))
            ids = rows.column("id").take(shard.order.take(pa.array(np.concatenate(docs))))
            found = pa.table({"query": np.concatenate(queries), "score": np.concatenate(scores), "id": ids})
            best = _k_best(found if best is None else pa.concat_tables([best, found]), k)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return search


def ranked_search(
    docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int = 10, *,
    shard_rows: int = SHARD_ROWS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k best documents of each query with a score above 0: query id, rank from 1, document id, score.

    Both tables have a column `text`; document ids are of a type that sorts. The sizes of shards and blocks don't
    change the result.
    """
    spark = prepare(docs.sparkSession)
    asked = _counts(queries.select(F.col(query_id).alias("id"), "text"))
    asked = write_once(asked.withColumn("query", F.monotonically_increasing_id()))
    wanted = asked.select("query", F.explode("terms").alias("term"))
    terms = write_once(wanted.select("term").distinct())
    counted = write_once(_counts(docs.select(F.col(doc_id).alias("id"), "text"), _term_filter(terms)))
    n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    wanted = write_once(wanted.join(_weights(counted, terms, n_docs), "term"))
    m = F.expr(f"10 + (CAST(90 AS DECIMAL(3, 0)) * CAST(n AS DECIMAL(15, 0)) * CAST({n_docs} AS DECIMAL(15, 0))) div {total}")
    rows = counted.where(F.size("terms") > 0).select("id", m.alias("m"), "terms", "times")
    schema = f"query long, score long, id {counted.schema['id'].dataType.simpleString()}"
    blocks = -(-wanted.count() // block_terms)
    path = scratch_path(spark, ".parquet")
    spark.createDataFrame([], schema).write.parquet(path)
    for i in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            with shuffles_removed(spark):
                rows.mapInArrow(_search(Block.of(block), k, shard_rows), schema).write.mode("append").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *ascending("id")))
    best = spark.read.schema(schema).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k)
    named = best.join(asked.select("query", F.col("id").alias("query_id")), "query")
    return named.select(F.col("query_id").alias(query_id), "rank", F.col("id").alias(doc_id), "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same result from all scores.
SQL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM lengths),
lists AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM postings, totals GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN lists USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

"""Periodic runs of words: stretches that repeat a block of words four times or more.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(6, 4 q) words long, that no
neighbouring word extends with the same period. Documents are cut into overlapping tiles, one set of tiles for each
octave of periods; a tile is as long as its periods need, so the work is linear in the words for each octave. Tiles are
dealt over the cluster and solved alone: at every boundary two Z-functions tell how far the words before and after it
go on with each period of the octave. What a tile finds are intervals of places i with word i = word i + q; intervals
that touch belong to one run, so a shuffle by document and period stitches them.

Null and empty texts have no words and no runs. Rows are told apart by id and text: repeated rows each get the same
result, and so do rows whose id is null. Columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import mix, prepare
from sojourn.session import write_once

#: A run repeats its block so many times, and has so many words at least.
TIMES, LEAST = 4, 6
#: Periods below this are one octave, found by comparing words directly.
SHORT = 8
#: Places that a tile answers for, unless its periods are longer.
CORE = 1024

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, split at ASCII white space, and a number for each that is the same for equal words."""
    words = (text or "").encode().split()
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return words, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    at = np.flatnonzero(true)
    if not len(at):
        return at, at
    cuts = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]] + 1


def least_places(period: int) -> int:
    """Places i with word i = word i + period that a run has at least."""
    return max(LEAST, TIMES * period) - period


def tiles_of(x: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """`(octave, first place, core, boundaries)` of each tile that may touch a run; the octave is its least period, or 1.

    Tiles of short periods are those with a stretch that is long enough. In longer octaves s to 2 s a boundary stands
    at every s-th word. A run goes over three of them or more, and the words that follow its first two come again
    together, q later; hashes of s words at each place tell where that can be.
    """
    n = len(x)
    marked = np.zeros(n // CORE + 1, bool)
    for period in range(1, SHORT):
        if n < max(LEAST, TIMES * period):
            break
        begins, ends = stretches(x[period:] == x[:-period])
        for i in np.flatnonzero(ends - begins >= least_places(period)):
            marked[begins[i] // CORE : (ends[i] - 1) // CORE + 1] = True
    yield from ((1, int(t) * CORE, CORE, None) for t in np.flatnonzero(marked))
    s, hashes = 1, mix(x.astype(np.uint64) + np.uint64(1))
    while TIMES * s <= n:
        if s >= SHORT:
            core = max(s, CORE)
            blocks = -(-n // s)
            at = np.zeros(blocks * s, np.uint64)
            at[: len(hashes)] = hashes | np.uint64(1)  # 0: fewer than s words follow
            at = at.reshape(blocks, s)
            again = (at[1:] == at[:-1, :1]) & (at[:-1, :1] != 0)
            first = np.flatnonzero((again[1:] & again[:-1]).any(axis=1))
            boundaries = np.unique(np.concatenate([first, first + 1, first + 2])) * s
            for t in np.unique(boundaries // core).tolist():
                yield s, t * core, core, boundaries[boundaries // core == t] - t * core
        hashes = hashes[:-s] * np.uint64(0x9E3779B97F4A7C15) + hashes[s:]
        hashes ^= hashes >> np.uint64(29)
        s *= 2


def z_function(x: list[int]) -> list[int]:
    """How many values from each place on are the same as from the begin on (0 at the begin)."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


_PRIMES: list[list[int]] = [[], []]


def prime_factors(n: int) -> list[int]:
    """The different primes that divide n, from a sieve that grows as needed."""
    if n >= len(_PRIMES):
        size = max(2 * len(_PRIMES), n + 1, 1024)
        _PRIMES[:] = [[] for _ in range(size)]
        for p in range(2, size):
            if not _PRIMES[p]:
                for multiple in range(p, size, p):
                    _PRIMES[multiple].append(p)
    return _PRIMES[n]


def solve_short(x: np.ndarray, core: int, first: bool) -> Iterator[tuple[int, int, int]]:
    """`(period, begin, end)` of the places in the core, for the periods below SHORT. `first`: nothing lies before it."""
    for period in range(1, min(SHORT, len(x))):
        begins, ends = stretches(x[period : period + core] == x[: min(core, len(x) - period)])
        for begin, end in zip(begins.tolist(), ends.tolist()):
            inside = (begin > 0 or first) and end < core
            if inside and end - begin < least_places(period):
                continue
            block = x[begin : begin + period]
            steps = (period // p for p in prime_factors(period))
            if not any((block[d:] == block[:-d]).all() for d in steps):
                yield period, begin, end


def solve_octave(x: np.ndarray, s: int, boundaries: list[int]) -> Iterator[tuple[int, int, int]]:
    """As :func:`solve_short` for the periods s to 2 s - 1, at the boundaries that may be in a run.

    Around a boundary b, the places that go on with period q are as many before b as the words before b and before b + q
    end alike, and as many after as the words from there on begin alike; s each way are enough, as the next boundary
    goes on. What s places on neither side reach is too short for a run. A block of words that is itself a power has a
    shorter period, and is left to that.
    """
    x = x.tolist()
    open_: dict[int, tuple[int, int]] = {}
    for b in boundaries:
        upto = min(2 * s, len(x) - b)  # words from b on that the tile has, of those that the periods need
        if upto <= s:
            continue
        ahead = z_function(x[b : b + 3 * s])
        behind = x[max(0, b - s) : b][::-1]
        reach = len(behind)
        back = z_function([*behind, -1, *x[b : b + 2 * s][::-1], *behind])
        right = np.minimum(ahead[s:upto], s)
        left = np.minimum(back[reach + 2 : reach + 2 + upto - s][::-1], s) if reach else np.zeros_like(right)
        for q in (np.flatnonzero((right == s) | (left == s)) + s).tolist():
            if any(ahead[q // p] >= q - q // p for p in prime_factors(q)):
                continue
            first, last = b - int(left[q - s]), b + int(right[q - s])
            begin, end = open_.get(q, (0, -1))
            if first <= end:
                open_[q] = begin, max(end, last)
            else:
                if end >= 0:
                    yield q, begin, end
                open_[q] = first, last
    yield from ((q, begin, end) for q, (begin, end) in open_.items())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "octave", "place", "core", "boundaries", "words"]
    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text").to_pylist()):
            x = word_numbers(text)[1]
            rows, size = [], 0
            for s, place, core, boundaries in tiles_of(x):
                words = x[place : place + core + SHORT] if s == 1 else x[max(0, place - s) : place + core + 3 * s]
                rows.append((key.as_py(), s, place, core, None if boundaries is None else boundaries.tolist(), words.tobytes()))
                size += words.nbytes
                if size > 1 << 22:
                    yield _tile_batch(rows, names)
                    rows, size = [], 0
            if rows:
                yield _tile_batch(rows, names)


def _tile_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tile in batch.to_pylist():
            x, s, place = np.frombuffer(tile["words"], np.int32), tile["octave"], tile["place"]
            before = 0 if s == 1 else min(s, place)
            if s == 1:
                found = solve_short(x, tile["core"], place == 0)
            else:
                found = solve_octave(x, s, [before + b for b in tile["boundaries"]])
            shift = place - before
            rows += [(tile["key"], q, begin + shift, end + shift) for q, begin, end in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "period", "begin", "end"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = (text or "").encode().split()
            if runs:
                change = np.zeros(len(words) + 1, np.int64)
                for run in runs:
                    change[run["start"] + run["period"]] += 1
                    change[run["start"] + run["length"]] -= 1
                words = [w for w, inside in zip(words, np.cumsum(change).tolist()) if not inside]
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("runs"), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"]
        )


def stitch(pieces: DataFrame) -> DataFrame:
    """`(key, start, length, period)` of the runs, from intervals of places that overlap or touch."""
    pieces = pieces.groupBy("key", "period", "begin").agg(F.max("end").alias("end"))  # repeated rows found them too
    order = Window.partitionBy("key", "period").orderBy("begin")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = reached.isNull() | (F.col("begin") > reached)
    pieces = pieces.withColumn("no", begins.cast("long"))
    pieces = pieces.withColumn("no", F.sum("no").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = pieces.groupBy("key", "period", "no").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    runs = runs.withColumn("length", F.col("end") - F.col("start") + F.col("period"))
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """`(doc_id, runs, collapsed)`: a document's runs by start and period, and its text without the words that repeat.

    `runs` are structs of start, length and period in words, empty without any. `collapsed` keeps of each run the first
    period, and words that are in no run; words are joined by single spaces.
    """
    prepare(docs.sparkSession)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", "text", F.unhex(F.md5(name)).alias("key"))
    tiles = docs.select("key", "text").mapInArrow(_cut, "key binary, octave long, place long, core long, boundaries array<long>, words binary")
    # the input's partition parts the tiles of rows that are alike
    tiles = tiles.withColumn("part", F.spark_partition_id()).repartition("key", "octave", "place", "part")
    pieces = tiles.drop("part").mapInArrow(_solve, "key binary, period long, begin long, end long")
    runs = F.struct("start", "length", "period")
    # written, so that both sides of the join below are plain shuffles, which Spark can split; merged at every size, as
    # the runs grow with the documents
    by_key = write_once(stitch(pieces).groupBy("key").agg(F.sort_array(F.collect_list(runs)).cast(RUNS).alias("runs")))
    none = F.array().cast(RUNS)
    found = docs.join(by_key.hint("merge"), "key", "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return found.mapInArrow(_collapse, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """The documents of the registered query: a tenth of them goes on with a block of their own words.

    With h the crc32 of the id's digits, g = h div 10 and n words, where h mod 10 is 0 each word i from a = g mod n on
    becomes the word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    changed = F.expr("""
        array_join(transform(words, (word, i) -> IF(i < a, word, element_at(words, CAST(a + (i - a) % p AS INT) + 1))), ' ')
    """)
    rows = rows.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("a", F.expr("IF(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The registered query's columns: of the run with the greatest exponent, and digests of all runs and of the rest."""
    # whole part and rest of the exponent: their quotients are exact for texts of less than 2^28 words
    best = F.expr("""
        array_sort(runs, (l, r) -> CASE
            WHEN l.length div l.period <> r.length div r.period
                THEN IF(l.length div l.period > r.length div r.period, -1, 1)
            WHEN (l.length % l.period) * r.period <> (r.length % r.period) * l.period
                THEN IF((l.length % l.period) * r.period > (r.length % r.period) * l.period, -1, 1)
            WHEN l.start <> r.start THEN IF(l.start < r.start, -1, 1)
            ELSE CAST(signum(l.period - r.period) AS INT) END)[0]
    """)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

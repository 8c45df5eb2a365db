"""Repeated passages across documents, found in the de Bruijn graph of token windows.

An edge of the graph is a run of `window` words. Windows of a document that choose the same seed (the run of
SEED_WORDS words with the least hash in the window) follow one another without a branch, and make a path.
Equal windows choose equal seeds at equal places, so a window can only repeat within paths of one seed:

1. joins on the seed leave the paths whose seed occurs again,
2. equal paths compact into one, with a count and the source coordinates of one occurrence,
3. a seed with one path only is settled: the whole path repeats, or none of it does,
4. for a seed where paths branch, one occurrence of each distinct path is read again at its source
   coordinates, and its windows are counted one by one, weighted by the path's count.

A path's repeated windows are a bit mask, as it has at most window - SEED_WORDS + 1 of them. The masks go back
to all occurrences, and each document drops the words that its repeated windows cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import Words, bounds, mix, prepare, span_hashes, text_slices, word_hashes, words_of
from sojourn.session import write_once

SEED_WORDS = 16
#: Two hashes of id and text, which stand for a document: rows may share an id or have none.
ROW = ["row", "check"]


class Paths:
    """The paths of some texts: `owner` text, `seed` hash, `content` hash, first window and number of windows."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        self.hashes = word_hashes(words)
        n = np.diff(words.first)
        count = np.maximum(n - window + 1, 0)
        owner = np.repeat(np.arange(len(n)), count)
        self.starts = words.first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        if not len(owner):
            self.owner = self.first = self.size = self.begin = np.zeros(0, np.int64)
            self.seed = self.content = np.zeros(0, np.uint64)
            return
        at = np.arange(len(self.hashes) - SEED_WORDS + 1)
        seeds = span_hashes(self.hashes, at, at + SEED_WORDS)
        chosen = _first_minimum(seeds, window - SEED_WORDS + 1)[self.starts] + self.starts
        new = np.ones(len(owner), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        self.begin = begin
        self.size = np.diff(np.append(begin, len(owner)))
        self.owner = owner[begin]
        self.first = self.starts[begin] - words.first[self.owner]
        self.seed = seeds[chosen[begin]]
        last = self.starts[begin] + self.size - 1 + window
        place = (chosen[begin] - self.starts[begin]).astype(np.uint64)  # tells apart equal words around other seeds
        self.content = mix(span_hashes(self.hashes, self.starts[begin], last) + place)

    def windows(self, path: int) -> np.ndarray:
        """Hashes of the windows of a path."""
        starts = self.starts[self.begin[path] : self.begin[path] + self.size[path]]
        return span_hashes(
            self.hashes[starts[0] : starts[-1] + self.window], starts - starts[0], starts - starts[0] + self.window
        )


def _first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Where each run of `width` values has its first minimum, from the run's begin; shorter runs at the end too."""
    best, place, span = values.copy(), np.zeros(len(values), np.int64), 1
    while span < width:
        step = min(span, width - span)  # runs may overlap
        n = max(0, len(values) - step)
        later = best[step:] < best[:n]
        place[:n] = np.where(later, place[step:] + step, place[:n])
        best[:n] = np.where(later, best[step:], best[:n])
        span += step
    return place


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _path_rows(docs: DataFrame, window: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            paths = Paths(words_of(texts), window)
            yield pa.RecordBatch.from_arrays(
                [
                    _longs(paths.seed),
                    _longs(paths.content),
                    *(part.column(c).take(pa.array(paths.owner)) for c in ROW),
                    pa.array(paths.first, pa.int32()),
                    pa.array(paths.size, pa.int32()),
                ],
                names=["seed", "content", *ROW, "first", "size"],
            )

    return docs.select(*ROW, "text").mapInArrow(
        read, "seed long, content long, row long, check long, first int, size int"
    )


def _window_rows(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """(hash, seed, content, bit, times) of the windows of the chosen paths, at their source coordinates."""
    sources = chosen.groupBy(*ROW).agg(F.collect_list(F.struct("first", "seed", "content", "times")).alias("paths"))
    named = ["hash", "seed", "content", "bit", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            paths = Paths(words_of(texts), window)
            at = dict(zip(zip(paths.owner.tolist(), paths.first.tolist()), range(len(paths.owner))))
            hashes, rows = [np.zeros(0, np.uint64)], []
            for owner, wanted in enumerate(part.column("paths").to_pylist()):
                for path in wanted:
                    found = paths.windows(at[owner, path["first"]])
                    hashes.append(found)
                    rows += [(path["seed"], path["content"], bit, path["times"]) for bit in range(len(found))]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [_longs(np.concatenate(hashes)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=named
            )

    return docs.join(sources, ROW).select("text", "paths").mapInArrow(
        read, "hash long, seed long, content long, bit int, times long"
    )


def repeated_paths(docs: DataFrame, window: int) -> DataFrame:
    """(ROW, first, mask): of the path whose first window is `first`, the windows with a bit in `mask` repeat."""
    paths = _path_rows(docs, window)
    # written, so that the join below has its own shuffle of it and Spark can split a seed of many paths
    again = write_once(paths.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
    paths = write_once(paths.join(again, "seed", "left_semi"))
    compact = paths.groupBy("seed", "content").agg(
        F.count("*").alias("times"), F.min(F.struct(*ROW, "first")).alias("source"), F.first("size").alias("size")
    )
    compact = write_once(compact.select("seed", "content", "times", "source.*", "size"))
    branching = compact.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    branching = write_once(branching)
    settled = (
        compact.where("times > 1")
        .join(branching, "seed", "left_anti")
        .select("seed", "content", F.expr("shiftleft(1L, size) - 1").alias("mask"))
    )
    windows = write_once(_window_rows(docs, compact.join(branching, "seed", "left_semi"), window))
    twice = windows.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1").select("hash")
    opened = (
        windows.join(twice, "hash", "left_semi")
        .groupBy("seed", "content")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    )
    masks = write_once(settled.union(opened))
    return paths.join(masks, ["seed", "content"]).select(*ROW, "first", "mask")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text.

    Words are runs of bytes other than ASCII white space, kept unchanged and joined by single blanks. A word is
    removed if it lies in a window of `window` words that also starts elsewhere, in the same document or in
    another; windows are judged on the input. `window` is SEED_WORDS to 60 + SEED_WORDS words long. A null text
    has no words. Rows may share an id: each row is a document of its own.
    """
    if not SEED_WORDS <= window <= 60 + SEED_WORDS:
        raise ValueError("the window doesn't fit a mask")
    prepare(docs.sparkSession)
    row = F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check")
    docs = docs.select(*row, "doc_id", "text")
    marks = (
        repeated_paths(docs.select(*ROW, "text"), window)
        .groupBy(*ROW)
        .agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    )
    kind = dict(docs.dtypes)["doc_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            words = words_of(texts)
            total, removed, kept = [], [], []
            split = texts.cast(pa.binary()).to_pylist()
            for (i, a, b), data, marks in zip(bounds(words.first), split, part.column("marks").to_pylist()):
                drop = np.zeros(b - a + 1, np.int64)
                for mark in marks or ():
                    for bit in range(mark["mask"].bit_length()):
                        if mark["mask"] >> bit & 1:
                            drop[mark["first"] + bit] += 1
                            drop[mark["first"] + bit + window] -= 1
                keep = np.cumsum(drop[:-1]) == 0
                total.append(b - a)
                removed.append(b - a - int(keep.sum()))
                kept.append(b" ".join(compress(data.split(), keep.tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return docs.join(marks, ROW, "left").select("doc_id", "text", "marks").mapInArrow(
        remove, f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    )

"""Benchmark decontamination: rare n-gram seeds find passages of documents, Smith-Waterman alignment scores them.

An alignment that reaches the least score loses a bounded number of points, and each word or pair of words that
it breaks costs some. So of enough n-grams of an item a known number are intact in every copy, however it was
edited; passages with that many are aligned, and no others can reach the score.

The test items stay bounded in memory: their seeds are looked up in blocks of `BLOCK_ITEMS` items, with one
scan of the documents for each block. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import ALNUM, Words, bounds, prepare, span_hashes, text_slices, word_hashes, words_of

#: Words of a seed, and the least score that an alignment loses with each seed that it breaks: 2 with a word that
#: it leaves out or replaces, 1 with a pair of words (one word put between them).
SEEDS = {1: 2, 2: 1}
#: Items of fewer words match only exactly.
LEAST_WORDS = 4
#: Longer items are also looked for in pieces of so many words that begin at every PIECE_STEP-th word. So a run of
#: PIECE_WORDS - PIECE_STEP + 1 = 30 words of an item lies within a piece, and is the least share of it.
PIECE_WORDS, PIECE_STEP = 50, 21
#: Seeds of an item that are in every copy, if it has so many; with more of them fewer passages are aligned in vain.
INTACT = 4
#: Least alignment score, as a share of what the whole item would score against itself.
LEAST_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items whose seeds are held in memory at once.
BLOCK_ITEMS = 20_000
#: Cells of the alignment matrices that are held at once, unless one pair needs more.
CELLS = 1 << 20
#: Seeds found in texts that are worked on at once, unless a single text has more.
HITS = 1 << 21
_FILTER_BITS = 22


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = words_of(pc.utf8_lower(texts), ALNUM)
    return words, word_hashes(words)


def _grams(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and words of every seed-long run of words within one text, by width."""
    n = np.diff(words.first)
    places, grams, widths = [], [], []
    for width in SEEDS:
        count = np.maximum(n - width + 1, 0)
        owner = np.repeat(np.arange(len(n)), count)
        starts = words.first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        places.append(starts)
        grams.append(span_hashes(hashes, starts, starts + width))
        widths.append(np.full(len(starts), width))
    return np.concatenate(places), np.concatenate(grams), np.concatenate(widths)


class _Lookup:
    """Which of some hashes are among the known ones: a bit table first, then binary search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hits, and which known hash each is."""
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        place = np.searchsorted(self.known, hashes[maybe])
        place = np.minimum(place, max(len(self.known) - 1, 0))
        hit = self.known[place] == hashes[maybe] if len(self.known) else np.zeros(len(maybe), bool)
        return maybe[hit], place[hit]


def _frequencies(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each known n-gram occurs in all documents."""
    lookup = docs.sparkSession.sparkContext.broadcast(_Lookup(known))  # bounded by BLOCK_ITEMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lookup.value.known), np.int64)
        for _, texts in text_slices(batches):
            _, which = lookup.value(_grams(*_words(texts))[1])
            total += np.bincount(which, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["gram", "times"])

    rows = docs.select("text").mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times")).collect()
    times = np.zeros(len(known), np.int64)
    for gram, total in rows:  # one row per n-gram of the block at most
        times[gram] = total
    return times


class _Items:
    """The items of one block and then the pieces of long ones: their words, and the seeds with the item and place of each."""

    def __init__(self, docs: DataFrame, texts: list[str], least_score: float):
        words, hashes = _words(pa.array(texts, pa.string()))
        #: The item of each piece.
        self.whole = list(range(len(texts)))
        parts = [hashes[a:b] for _, a, b in bounds(words.first)]
        for item, n in enumerate(np.diff(words.first).tolist()):
            if n > PIECE_WORDS:
                for a in [*range(0, n - PIECE_WORDS, PIECE_STEP), n - PIECE_WORDS]:
                    self.whole.append(item)
                    parts.append(parts[item][a : a + PIECE_WORDS])
        n = np.array([len(part) for part in parts], np.int64)
        self.hashes = np.concatenate(parts) if parts else hashes
        self.first = np.append(0, np.cumsum(n))
        words = Words(words.data, words.starts, words.ends, self.first)
        #: The least share of its own score with which an item or a piece is found.
        self.least = np.where(n < LEAST_WORDS, 1.0, least_score)
        #: What an alignment may lose, in points; no more words than this are put in between.
        self.loss = np.floor(MATCH * n * (1 - self.least) + 1e-9).astype(np.int64)
        #: Seeds that every alignment with the least score keeps.
        self.intact = np.ones(len(parts), np.int64)
        starts, grams, widths = _grams(words, self.hashes)
        known = np.unique(grams)
        times = _frequencies(docs, known)[np.searchsorted(known, grams)] if len(known) else np.zeros(0, np.int64)
        owner = np.searchsorted(self.first, starts, side="right") - 1
        chosen = []
        edges = {w: np.searchsorted(owner[widths == w], np.arange(len(parts) + 1)) for w in SEEDS}
        base = {w: int(np.searchsorted(widths, w)) for w in SEEDS}
        for item in np.flatnonzero(n).tolist():
            best = None
            for width, cost in SEEDS.items():
                a, b = (base[width] + edges[width][item : item + 2]).tolist()
                broken = int(self.loss[item]) // cost
                if b - a - broken < width:  # single words when a pair alone would have to do
                    continue
                rare = a + np.argsort(times[a:b], kind="stable")[: broken + INTACT]
                if best is None or times[rare].sum() < times[best].sum():
                    best, self.intact[item] = rare, len(rare) - broken
            chosen.append(best)
        seeds = np.concatenate(chosen).astype(np.int64) if chosen else np.zeros(0, np.int64)
        seeds = seeds[np.argsort(grams[seeds], kind="stable")]
        self.lookup = _Lookup(np.unique(grams[seeds]))
        self.edges = np.append(np.searchsorted(grams[seeds], self.lookup.known), len(seeds))
        self.item, self.place = owner[seeds], starts[seeds] - self.first[owner[seeds]]

    def size(self, item: np.ndarray) -> np.ndarray:
        return self.first[item + 1] - self.first[item]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and the passage's word where it ends."""
    rows, width = max(map(len, items)), max(map(len, passages))
    left = np.zeros((len(items), rows), np.uint64)
    right = np.ones((len(items), width), np.uint64)  # differs from the filling of `left`
    for i, (x, y) in enumerate(zip(items, passages)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    row = np.zeros((len(items), width + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(rows):
        step = np.zeros_like(row)
        step[:, 1:] = row[:, :-1] + np.where(left[:, i : i + 1] == right, MATCH, MISMATCH)
        step = np.maximum(np.maximum(step, row + GAP), 0)
        row = np.maximum.accumulate(step + ramp, axis=1) - ramp  # gaps along the passage
        place = row.argmax(axis=1)
        top = row[np.arange(len(row)), place]
        end = np.where(top > best, place, end)
        best = np.maximum(best, top)
    return best, end


def _passages(
    items: _Items, words: Words, at: np.ndarray, which: np.ndarray, text: np.ndarray
) -> list[tuple[int, int, int, int]]:
    """(text, item, begin, end) of the passages with enough of the seeds that lie at the given places."""
    repeat = items.edges[which + 1] - items.edges[which]
    seed = np.repeat(items.edges[which], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    item, start = items.item[seed], np.repeat(at, repeat) - items.place[seed]  # start: of the item, were it unedited
    text = np.repeat(text, repeat)
    order = np.lexsort((start, item, text))
    text, item, start = text[order], item[order], start[order]
    group = np.cumsum(np.append(False, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))) if len(text) else text
    # the starts of one alignment's seeds differ by the words put in and left out
    key = group * (np.ptp(start) + int(items.loss.max()) + 1) + start if len(start) else start
    near = np.searchsorted(key, key + items.loss[item], side="right") - np.arange(len(key))
    enough = np.flatnonzero(near >= items.intact[item])
    text, item, start = text[enough], item[enough], start[enough]
    size, loss = items.size(item), items.loss[item]
    begin = np.maximum(start - loss, words.first[text])
    end = np.minimum(start + size + loss, words.first[text + 1])
    found: list[tuple[int, int, int, int]] = []
    for t, i, a, b, half in zip(text.tolist(), item.tolist(), begin.tolist(), end.tolist(), (size // 2).tolist()):
        if found and found[-1][:2] == (t, i) and a - found[-1][2] <= half:
            found[-1] = (t, i, found[-1][2], max(b, found[-1][3]))  # seeds of the same passage
        else:
            found.append((t, i, a, b))
    return found


def _candidates(items: _Items, words: Words, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, begin, end) of the passages that share enough seeds with an item."""
    starts, grams, _ = _grams(words, hashes)
    hit, which = items.lookup(grams)
    order = np.argsort(starts[hit], kind="stable")
    at, which = starts[hit][order], which[order]
    text = np.searchsorted(words.first, at, side="right") - 1
    total = np.cumsum(items.edges[which + 1] - items.edges[which])
    found, a = [], 0
    while a < len(at):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right"))
        if b < len(at):  # whole texts
            b = int(np.searchsorted(text, text[b]))
            b = b if b > a else int(np.searchsorted(text, text[a], side="right"))
        found += _passages(items, words, at[a:b], which[a:b], text[a:b])
        a = b
    return found


def _aligned(
    items: _Items, hashes: np.ndarray, pairs: list[tuple[int, int, int, int]]
) -> Iterator[tuple[tuple[int, int, int, int], int, int]]:
    """Each pair with the best score and the passage's word where it ends; pairs of like size are aligned side by side."""
    pairs = sorted(pairs, key=lambda p: (int(items.size(np.array(p[1]))), p[3] - p[2]))
    while pairs:
        cells = np.cumsum([p[3] - p[2] for p in pairs[:4096]])
        some = pairs[: max(1, int(np.searchsorted(cells, CELLS // 64)))]
        pairs = pairs[len(some) :]
        best, end = align(
            [items.hashes[items.first[i] : items.first[i + 1]] for _, i, _, _ in some],
            [hashes[a:b] for _, _, a, b in some],
        )
        yield from zip(some, best.tolist(), end.tolist())


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document and item of which it holds a copy: doc_id, item_id, score, first_word, last_word.

    Score is the best local alignment over words (lower case, punctuation aside) as a share of the item's own;
    words are numbered from 0. Every copy with that score is found, wherever it was edited. Of items of
    more than PIECE_WORDS words also a passage is found that has the least score for a piece of PIECE_WORDS words (30
    words without a change); its score may be below `least_score`. Items of fewer than LEAST_WORDS words match only
    exactly. Null and empty texts match nothing; rows of a repeated id count as one. `docs` needs doc_id and text, `benchmark` item_id and text.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word long, last_word long"
    numbered = benchmark.select("item_id", "text").where("text IS NOT NULL")
    blocks = max(1, -(-numbered.count() // BLOCK_ITEMS))
    found = []
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()  # about BLOCK_ITEMS rows
        ids = rows.column("item_id").combine_chunks()
        model = spark.sparkContext.broadcast(_Items(docs, rows.column("text").to_pylist(), least_score))

        def score(
            batches: Iterator[pa.RecordBatch], model: object = model, ids: pa.Array = ids
        ) -> Iterator[pa.RecordBatch]:
            items: _Items = model.value
            for part, texts in text_slices(batches):
                words, hashes = _words(texts)
                pairs = _candidates(items, words, hashes)
                kept, long = [], {}
                for (t, i, a, b), top, last in _aligned(items, hashes, pairs):
                    share = top / (MATCH * int(items.size(np.array(i))))
                    if share < items.least[i]:
                        continue
                    whole = items.whole[i]
                    if whole == i:
                        kept.append((t, i, share, a - int(words.first[t]), a - int(words.first[t]) + last - 1))
                    else:  # a passage of a long item: the whole item's score is that around it
                        n = int(items.size(np.array(whole)))
                        a, b = max(a - MATCH * n, int(words.first[t])), min(b + MATCH * n, int(words.first[t + 1]))
                        before = long.get((t, whole), (a, b))
                        long[t, whole] = min(a, before[0]), max(b, before[1])
                for (t, i, a, _), top, last in _aligned(items, hashes, [(*key, *span) for key, span in long.items()]):
                    share = top / (MATCH * int(items.size(np.array(i))))
                    kept.append((t, i, share, a - int(words.first[t]), a - int(words.first[t]) + last - 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([k[0] for k in kept], pa.int64())),
                        ids.take(pa.array([k[1] for k in kept], pa.int64())),
                        pa.array([k[2] for k in kept], pa.float64()),
                        pa.array([k[3] for k in kept], pa.int64()),
                        pa.array([k[4] for k in kept], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"],
                )

        found.append(docs.mapInArrow(score, schema))
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")

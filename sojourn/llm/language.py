"""Language ID by cross-parsing: a text is cut into the longest phrases that occur in a language's sample.

A suffix automaton of the sample gives the longest match at each place. The language in which a text
needs the fewest phrases per letter wins. Learning needs a bounded sample only (`SAMPLE_TEXTS` pieces
of at most `PIECE_CHARS` characters per language, chosen by hash); prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import prepare, text_slices, utf8

SAMPLE_TEXTS = 64
PIECE_CHARS = 768
#: Symbols of a text that are parsed in one go; a phrase doesn't go beyond.
SEGMENT = 512
UNDETERMINED = "und"
_COST = 30  # the bits above hold the phrases that a step ends
_STATE = np.uint32((1 << _COST) - 1)


def language_sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = PIECE_CHARS) -> DataFrame:
    """`texts` rows of each language, by hash of the id; of a longer text the piece begins at a hashed place.

    Input: doc_id, text, lang; rows with null text or lang are left out. Spark keeps the chosen rows of
    each map task only, so that a language with most of the rows needs no task of its own.
    """
    key = F.xxhash64(F.lit("sample"), "doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    piece = F.substring(F.col("text"), place.cast("int"), F.lit(chars))
    first = Window.partitionBy("lang").orderBy("key", "doc_id", "piece")
    return (
        labelled.where("text IS NOT NULL AND lang IS NOT NULL")
        .select("lang", "doc_id", key.alias("key"), piece.alias("piece"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= texts)
        .select("lang", "piece")
    )


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


class CrossParser:
    """Learned languages: the symbols that stand for bytes, and a step table of all automata.

    Symbol 0 is any run of characters that are no letters, 1 a byte no sample has. A step's entry is the
    row of the next state and, in the upper bits, how many phrases end there.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        folded = {lang: [_folded(pa.array([t]))[0] for t in sorted(samples[lang])] for lang in self.languages}
        letters = sorted({b for texts in folded.values() for t in texts for b in np.unique(t).tolist()} - {0x20})
        self.symbols = np.full(256, 1, np.uint8)
        self.symbols[0x20] = 0
        self.symbols[letters] = np.arange(2, len(letters) + 2)
        self.width = len(letters) + 2
        tables, self.roots = [], []
        base = 0
        for lang in self.languages:
            cut = self.width  # between pieces, and in no text
            learned = [s for t in folded[lang] for s in (*self.symbols[t].tolist(), cut)]
            edges = suffix_automaton(learned)
            table = np.full((len(edges), self.width), -1, np.int64)
            for state, out in enumerate(edges):
                for c, to in out.items():
                    if c != cut:
                        table[state, c] = to
            root = table[0].copy()
            ends = (np.arange(len(edges)) > 0)[:, None].astype(np.int64) + (root < 0)[None, :]
            miss = table < 0
            to = np.where(miss, np.maximum(root, 0)[None, :], table)
            tables.append(((base + to) * self.width | np.where(miss, ends, 0) << _COST).astype(np.uint32).ravel())
            self.roots.append(base * self.width)
            base += len(edges)
        if base * self.width >= 1 << _COST:
            raise ValueError("the samples of all languages are too large for one step table")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.uint32)

    def phrases(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per language and text, and symbols per text."""
        data, first = _folded(texts)
        symbols = self.symbols[data]
        size = np.diff(first)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[owner] + number * SEGMENT
        length = np.minimum(SEGMENT, first[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(longest), side="left")
        state = np.repeat(np.array(self.roots, np.uint32)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.uint32)
        for i in range(longest):
            n = active[i]
            step = self.table[state[:, :n] + symbols[begin[:n] + i]]
            count[:, :n] += step >> np.uint32(_COST)
            state[:, :n] = step & _STATE
        count += state != np.array(self.roots, np.uint32)[:, None]
        total = [np.bincount(owner, weights=row, minlength=len(size)) for row in count]
        return np.array(total).reshape(len(self.languages), len(size)), size


_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[_LETTER == 0] = 0x20


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with one blank for each run of characters that are no letters."""
    data, first = utf8(pc.utf8_lower(texts))
    data = _LETTER[data]
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return data[keep], before[first]


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify_language(docs: DataFrame, labelled: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """One row per row of `docs`: its columns in `keep`, lang_pred and score (0 to 1).

    `labelled` (doc_id, text, lang) is what may be learned from. Only `text` of `docs` is looked at.
    lang_pred is "und" with score 0 where the text is null or has no letter, or where nothing was learned.
    The score is how much fewer phrases the winner needs than the next language: 0 for a tie, which the
    first name wins, and 1 if there is one language only.
    """
    spark = prepare(docs.sparkSession)
    samples: dict[str, list[str]] = {}
    for row in language_sample(labelled).collect():  # at most SAMPLE_TEXTS short rows a language
        samples.setdefault(row["lang"], []).append(row["piece"])
    model = spark.sparkContext.broadcast(CrossParser(samples))  # its size follows from that of the samples
    keep = list(keep)
    given = docs.select(*keep, F.col("text").alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.value
        names = np.array([*parser.languages, UNDETERMINED], dtype=object)
        for part, texts in text_slices(batches, "_text"):
            count, _ = parser.phrases(texts)
            known = np.array([bool(parser.languages) and _has_letter(t) for t in texts.to_pylist()])
            best, score = np.full(len(texts), len(parser.languages)), np.zeros(len(texts))
            if parser.languages:
                best = np.where(known, np.argmin(count, axis=0), best)
                least = np.sort(count, axis=0)[:2]
                margin = 1 - least[0] / np.maximum(least[1], 1) if len(least) > 1 else np.ones(len(texts))
                score = np.where(known, margin, 0.0)
            columns = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    kinds = [f"`{name}` {kind}" for name, kind in docs.select(*keep).dtypes] if keep else []
    return given.mapInArrow(predict, ", ".join([*kinds, "lang_pred string", "score double"]))

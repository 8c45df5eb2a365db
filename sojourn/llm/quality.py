"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words, each hashed to one of 2^WORD_BITS weights and counted 1 / sqrt(words), and
the standardised statistics of `structure`. The pairwise part sums the interactions of all pairs of features
in time linear in their number: per factor it is half of (sum of v x)^2 - sum of (v x)^2.

The model is trained on the driver from at most LABELLED_ROWS labelled documents, chosen by hash. Scoring
reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import Words, prepare, text_slices, utf8, word_hashes, words_of

WORD_BITS = 16
FACTORS = 8
LABELLED_ROWS = 10_000
#: Texts beyond it are left out of the training sample (not of scoring), which bounds its memory.
TRAIN_BYTES = 200_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-6
STATISTICS = (
    "log bytes", "log words", "bytes per word", "lines per word", "longest word", "ASCII letters", "upper case",
    "digits", "other ASCII", "beyond ASCII", "distinct words", "commonest word", "distinct lines", "short words",
)


def _class(low: int, high: int) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[low : high + 1] = 1
    return table


_UPPER, _LOWER, _DIGIT, _HIGH = _class(0x41, 0x5A), _class(0x61, 0x7A), _class(0x30, 0x39), _class(0x80, 0xFF)
_SPACE = _class(0x09, 0x0D) | _class(0x20, 0x20)
_SIGN = 1 - (_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE)


def structure(texts: pa.Array, words: Words, hashes: np.ndarray) -> np.ndarray:
    """The STATISTICS of each text; those of an empty text are 0."""
    data, offsets = utf8(texts)
    size, n = np.diff(offsets), np.diff(words.first)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return np.diff(sums[offsets]) / np.maximum(size, 1)

    lines = np.diff(np.concatenate(([0], np.cumsum(data == 0x0A)))[offsets])
    length = words.ends - words.starts
    longest, distinct, commonest, short, same = (np.zeros(len(n)) for _ in range(5))
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        a, b = words.first[i], words.first[i + 1]
        if b > a:
            _, times = np.unique(hashes[a:b], return_counts=True)
            longest[i], distinct[i], commonest[i] = length[a:b].max(), len(times) / (b - a), times.max() / (b - a)
            short[i] = np.mean(length[a:b] <= 2)
            parts = text.split(b"\n")
            same[i] = len(set(parts)) / len(parts)
    per = np.maximum(n, 1)
    columns = (
        np.log1p(size), np.log1p(n), size / per, lines / per, np.log1p(longest), share(_UPPER | _LOWER), share(_UPPER),
        share(_DIGIT), share(_SIGN), share(_HIGH), distinct, commonest, same, short,
    )
    return np.stack(columns, axis=1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word features in a row, where each text's begin, and the statistics of each text."""
    words = words_of(texts)
    hashes = word_hashes(words, fold=True)
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32), words.first, structure(texts, words, hashes)


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text."""
    out = np.zeros((len(first) - 1, values.shape[1]), np.float64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled] = np.add.reduceat(values, first[filled], axis=0, dtype=np.float64)
    return out


class FactorisationMachine:
    """Weights w and factors v of words and statistics, side by side: column 0 is w, the others are v."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.words = np.zeros((1 << WORD_BITS, 1 + FACTORS), np.float32)
        self.words[:, 1:] = rng.normal(0, 0.05, (1 << WORD_BITS, FACTORS))
        self.stats = np.zeros((len(STATISTICS), 1 + FACTORS))
        self.stats[:, 1:] = rng.normal(0, 0.05, (len(STATISTICS), FACTORS))
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def _parts(self, rows: np.ndarray, first: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: value of a word feature, sums of w x and v x, and the logit."""
        unit = 1 / np.sqrt(np.maximum(np.diff(first), 1))
        sums = _summed(rows, first) * unit[:, None] + x @ self.stats
        squares = _summed(rows[:, 1:] ** 2, first) * unit[:, None] ** 2 + x**2 @ self.stats[:, 1:] ** 2
        return unit, sums, self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)

    def score(self, words: np.ndarray, first: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        logit = self._parts(self.words[words], first, self.standard(stats))[2]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> None:
        """Minimise the log loss over (words, statistics) of labelled texts, by AdaGrad."""
        if not len(labels):
            return
        stats = np.array([s for _, s in texts])
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        stats = self.standard(stats)
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        past = [np.full(p.shape, 1e-6, np.float32) for p in (self.words, self.stats)]
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                words = np.concatenate([texts[i][0] for i in some])
                first = np.concatenate(([0], np.cumsum([len(texts[i][0]) for i in some])))
                self._step(words, first, stats[some], labels[some], past)

    def _step(
        self, words: np.ndarray, first: np.ndarray, x: np.ndarray, labels: np.ndarray, past: list[np.ndarray]
    ) -> None:
        rows = self.words[words]
        unit, sums, logit = self._parts(rows, first, x)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
        n = np.diff(first)
        pull = np.concatenate((np.ones((len(n), 1)), sums[:, 1:]), axis=1) * (error * unit)[:, None]
        slope = np.repeat(pull, n, axis=0)
        slope[:, 1:] -= rows[:, 1:] * np.repeat(error * unit**2, n)[:, None]
        seen, place = np.unique(words, return_inverse=True)
        total = np.zeros((len(seen), 1 + FACTORS))
        np.add.at(total, place, slope)
        total += DECAY * self.words[seen]
        past[0][seen] += total**2
        self.words[seen] -= RATE * total / np.sqrt(past[0][seen])
        slope = x.T @ (np.concatenate((np.ones((len(n), 1)), sums[:, 1:]), axis=1) * error[:, None])
        slope[:, 1:] -= (x**2).T @ error[:, None] * self.stats[:, 1:]
        past[1] += slope**2
        self.stats -= RATE * slope / np.sqrt(past[1])
        self.bias -= RATE * float(error.sum())


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> FactorisationMachine:
    """A machine for `quality` (0 or 1) of `labels`, from at most `rows` of them; null labels and texts are left out."""
    order = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = labels.where("quality IS NOT NULL").select("doc_id", "quality").orderBy(order, "doc_id", "quality").limit(rows)
    wanted = F.broadcast(chosen.withColumnRenamed("doc_id", "labelled"))  # at most `rows` short rows
    sample = docs.select("doc_id", "text").join(wanted, F.expr("doc_id = labelled")).where(
        f"octet_length(text) <= {TRAIN_BYTES}"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            words, first, stats = features(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.string()),
                    part.column("quality").cast(pa.float64()),
                    pa.array([words[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()),
                    pa.array([s.tobytes() for s in stats], pa.binary()),
                ],
                names=["key", "quality", "words", "stats"],
            )

    table = sample.mapInArrow(read, "key string, quality double, words binary, stats binary").toArrow()
    table = table.sort_by([("key", "ascending"), ("quality", "ascending"), ("stats", "ascending")])
    texts = [
        (np.frombuffer(w.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.float64))
        for w, s in zip(table.column("words"), table.column("stats"))
    ]
    machine = FactorisationMachine()
    machine.fit(texts, table.column("quality").to_numpy())
    return machine


def quality_scores(docs: DataFrame, machine: FactorisationMachine, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Columns in `keep`, score (0 to 1, higher: better) and predicted (1 from 0.5 on) of every row.

    Only the text is looked at; a null text is an empty one, and gets the score of its statistics.
    """
    model = prepare(docs.sparkSession).sparkContext.broadcast(machine)  # 2^WORD_BITS rows, whatever the input
    keep = list(keep)
    kinds = [f"`{name}` {kind}" for name, kind in docs.select(*keep).dtypes] if keep else []

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text"):
            score = model.value.score(*features(texts))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    given = docs.select(*keep, F.col("text").alias("_text"))
    return given.mapInArrow(predict, ", ".join([*kinds, "score double", "predicted int"]))

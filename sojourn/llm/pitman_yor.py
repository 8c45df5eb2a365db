"""Language model scores: a hierarchical Pitman-Yor model of words after words.

Every token is a customer of a restaurant that its previous word names: one of 16384, a hash of the word within its
parent, which is one of 256 by the word's last two bytes. Tables of a restaurant are customers of its parent, tables of
the parents are customers of the root, and the root's base is uniform over the training words and one unknown word.

Seating is sampled by Gibbs, one word in one restaurant at a time: its customers are seated anew, one after the other,
given the rest of the restaurant, and the new seating is taken or refused by its weight against the last one, so that
the chain keeps the model's distribution. A table is opened by a customer with the chance a / (a + j - d t), when j sit
at t tables, d is the discount and a the chance that the parent serves the word times the restaurant's strength; from
64 customers on they are seated in groups of a 32nd of those who sit. The counts of a word in all restaurants are one
row, of 16640 numbers at most; what rows need of each other are the restaurants' totals, which each pass sums up and
hands to the next. The predictive probabilities are averaged over the samples of the last pass.

The corpus is read once and kept in slices: bounded lots of documents with their different words and the sequence of
word numbers. A slice asks for each of its words once, in the restaurants where it occurs. Questions meet the rows of
words by a join and answers return to the slices, so no task holds more than a slice or a lot of rows, whatever the
words' frequency.

Null and empty texts are an end alone. Rows are scored one by one, also under one id or none. Columns other than
`doc_id` and `text` are ignored. Without training documents each token has the base's probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import prepare
from sojourn.session import stored, write_once

#: Restaurants of a parent, parents; the ids of restaurants are 16-bit numbers.
LEAVES, PARENTS = 64, 256
N_LEAVES = LEAVES * PARENTS
#: Discounts and strengths of the root, the parents, and the restaurants of previous words.
DISCOUNT, STRENGTH = (0.5, 0.7, 0.8), (1.0, 1.0, 1.0)
#: Passes over the words with totals held, rounds from the leaves to the root in the last pass (one in those before),
#: samples in a round; the last round's samples but the first are averaged.
PASSES, ROUNDS, SAMPLES = 2, 2, 3
#: Bytes of text in a slice, unless a single text is longer.
SLICE = 32 << 20
#: Rows and bytes of rows that are worked on at once.
LOT_ROWS, LOT_BYTES = 1 << 15, 8 << 20
#: The end of a text as a word; no word holds white space.
END = b" "
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def restaurant(word: bytes) -> int:
    """Where tokens after this word sit; its parent is this divided by LEAVES."""
    return crc32(word[-2:]) % PARENTS * LEAVES + (crc32(word) >> 8) % LEAVES


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values of the runs of an array that begin at `starts`, with the end as last start."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _joined(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in a row, and how many each value has (null: none)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    width = np.dtype(kind).itemsize
    if ends[0] == ends[-1]:
        return np.zeros(0, kind), np.diff(ends)
    return np.frombuffer(buffers[2], kind, (ends[-1] - ends[0]) // width, int(ends[0])), np.diff(ends) // width


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables that are worth the while."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= LOT_ROWS or size >= LOT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24

    def begin():
        return _Numbers({END: 0}), [], [], [], []

    def row():
        columns = [
            pa.array([number]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)),
            pa.array([np.concatenate(train).tobytes()]), pa.array([np.array(lengths, np.int64).tobytes()]),
            pa.array([zstandard.compress(b"\n".join(words), 3)]), pa.array([_packed(np.concatenate(tokens))]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["slice", "doc_ids", "train", "lengths", "words", "tokens"])

    (words, ids, train, lengths, tokens), size = begin(), 0
    for batch in batches:
        taken = 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            data = (text or "").encode().translate(_LOWER)
            found = np.fromiter(map(words.__getitem__, data.split()), np.int32)
            tokens += [found, np.zeros(1, np.int32)]
            lengths.append(len(found) + 1)
            size += len(data)
            if size >= SLICE or i + 1 == batch.num_rows:
                ids.append(batch.column("doc_id").slice(taken, i + 1 - taken))
                train.append(batch.column("train").slice(taken, i + 1 - taken).to_numpy(zero_copy_only=False))
                taken = i + 1
            if size >= SLICE:
                yield row()
                number += 1
                (words, ids, train, lengths, tokens), size = begin(), 0
    if lengths:
        yield row()


class _Slice:
    """A slice: its words, and each token's word, restaurant, document and whether it is learned from."""

    def __init__(self, row: dict):
        self.words = zstandard.decompress(row["words"]).split(b"\n")
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.train = np.frombuffer(row["train"], bool)
        self.word = _unpacked(row["tokens"]).astype(np.int64)
        sits = np.array([restaurant(w) for w in self.words], np.int64)
        before = np.empty_like(self.word)
        before[1:] = sits[self.word[:-1]]
        before[np.cumsum(self.lengths) - self.lengths] = restaurant(b"")
        self.key = self.word << 16 | before

    def asked(self, keys: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Of sorted different keys the numbers of their words, the words, their restaurants, and where each begins."""
        starts = np.flatnonzero(np.diff(keys >> 16, prepend=-1))
        numbers = keys[starts] >> 16
        starts = np.append(starts, len(keys))
        words = pa.array([self.words[i].decode() for i in numbers.tolist()], pa.string())
        return numbers, words, _binaries((keys & 0xFFFF).astype(np.uint16), starts), starts


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            s = _Slice(row)
            keys, counts = np.unique(s.key[np.repeat(s.train, s.lengths)], return_counts=True)
            _, words, leaves, starts = s.asked(keys)
            yield from _parts([words, leaves, _binaries(counts.astype(np.uint32), starts)], ["word", "leaves", "counts"])


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            s = _Slice(row)
            numbers, words, leaves, _ = s.asked(np.unique(s.key))
            slices = pa.array(np.full(len(numbers), row["slice"]))
            yield from _parts([words, slices, pa.array(numbers), leaves], ["word", "slice", "number", "asked"])


def _parts(arrays: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.RecordBatch.from_arrays(arrays, names)
    yield from (table.slice(i, LOT_ROWS) for i in range(0, table.num_rows, LOT_ROWS))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word, from rows sorted by word; the last word of a lot waits for the next."""
    names = ["word", "leaves", "counts"]
    held = None
    for lot in _lots(batches):
        wide = _joined(lot.column("counts"), np.uint32)  # a slice has fewer than 2^32 words
        wide = _binaries(wide[0].astype(np.int64), np.append(0, np.cumsum(wide[1])))
        lot = pa.table([lot.column("word"), lot.column("leaves"), wide], names)
        lot = pa.concat_tables([held, lot]).combine_chunks() if held else lot
        words = lot.column("word")
        new = np.ones(lot.num_rows, bool)
        if lot.num_rows > 1:
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, lot.num_rows - 1)).to_numpy()
        leaves, sizes = _joined(lot.column("leaves"), np.uint16)
        keys = np.repeat(np.cumsum(new) - 1, sizes) << 16 | leaves
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, _joined(lot.column("counts"), np.int64)[0])
        starts = np.append(np.flatnonzero(np.diff(keys >> 16, prepend=-1)), len(keys))
        arrays = [
            words.take(pa.array(np.flatnonzero(new))).combine_chunks(), _binaries((keys & 0xFFFF).astype(np.uint16), starts),
            _binaries(counts, starts),
        ]
        merged = pa.Table.from_arrays(arrays, names)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
        held = merged.slice(merged.num_rows - 1)
    if held:
        yield from held.to_batches()


def seat(customers: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of customers seated one after the other, and the logarithm of the seating's weight over its chance."""
    tables, weight = np.ones(len(customers), np.int64), np.zeros(len(customers))
    more = np.flatnonzero(customers > 1)  # one customer has one table
    order = more[np.argsort(-customers[more], kind="stable")]
    c, a = customers[order], a[order]
    t, w, seated = np.ones(len(c), np.int64), np.zeros(len(c)), 1
    while active := int(np.searchsorted(-c, -seated)):
        step = max(1, seated // 32)
        n = np.minimum(c[:active] - seated, step)
        mass = a[:active] + seated + (n - 1) / 2 - d * t[:active]
        w[:active] += n * np.log(mass)
        chance = a[:active] / mass
        t[:active] += rng.random(active) < chance if step == 1 else rng.binomial(n, np.minimum(chance, 1))
        seated += step
    tables[order], weight[order] = t, w
    return tables, weight


class _Rows:
    """Rows of words with their customers in all restaurants."""

    def __init__(self, lot: pa.Table):
        self.leaf, sizes = _joined(lot.column("leaves"), np.uint16)
        self.leaf = self.leaf.astype(np.int64)
        self.customers = _joined(lot.column("counts"), np.int64)[0]
        self.n = len(sizes)
        self.starts = np.append(0, np.cumsum(sizes))
        pairs = np.repeat(np.arange(self.n), sizes) * PARENTS + self.leaf // LEAVES
        pairs, self.up = np.unique(pairs, return_inverse=True)  # a leaf's row among the parents
        self.row, self.parent = pairs // PARENTS, pairs % PARENTS  # a parent's row among the words
        self.parent_starts = np.searchsorted(self.row, np.arange(self.n + 1))

    def sample(self, totals: Totals, rounds: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """Average customers and tables in the root, the parents and the leaves."""
        t2 = np.ones(len(self.leaf), np.int64)
        c1 = np.bincount(self.up, t2, len(self.parent)).astype(np.int64)
        t1 = np.ones(len(self.parent), np.int64)
        c0 = np.bincount(self.row, t1, self.n).astype(np.int64)
        t0 = np.ones(self.n, np.int64)
        means = [(c0, t0), (c1, t1), (self.customers, t2)]
        for _ in range(rounds):
            p0, p1 = totals.served(means[0], means[1], self.row, self.parent)
            kept = []
            states: list = [None] * 3
            for i in range(SAMPLES):
                states[2] = self._draw(states[2], self.customers, totals.strength[2][self.leaf] * p1[self.up], 2, rng)
                c1 = np.bincount(self.up, states[2][1], len(self.parent)).astype(np.int64)
                states[1] = self._draw(states[1], c1, totals.strength[1][self.parent] * p0[self.row], 1, rng)
                c0 = np.bincount(self.row, states[1][1], self.n).astype(np.int64)
                states[0] = self._draw(states[0], c0, np.full(self.n, totals.strength[0] * totals.base), 0, rng)
                if i:
                    kept.append([(c, t.astype(float)) for c, t in ((s[0], s[1]) for s in states)])
            means = [tuple(sum(k[level][x] for k in kept) / len(kept) for x in (0, 1)) for level in range(3)]
        return means

    @staticmethod
    def _draw(state, customers: np.ndarray, a: np.ndarray, level: int, rng: np.random.Generator):
        """A new seating for each word and restaurant, or the last one; where the customers changed, a new one."""
        tables, weight = seat(customers, a, DISCOUNT[level], rng)
        if state is None:
            return customers, tables, weight
        take = (state[0] != customers) | (np.log(rng.random(len(a))) < weight - state[2])
        return customers, np.where(take, tables, state[1]), np.where(take, weight, state[2])


class Totals:
    """Customers and tables of all restaurants, and what follows from them."""

    def __init__(self, customers: list, tables: list, n_words: int):
        self.base = 1 / (n_words + 1)
        self.strength = [s + d * t for s, d, t in zip(STRENGTH, DISCOUNT, tables)]
        self.size = [s + c for s, c in zip(STRENGTH, customers)]

    def served(self, root, parents, row: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities of words in the root, and in the parents where they have customers."""
        p0 = (root[0] - DISCOUNT[0] * root[1] + self.strength[0] * self.base) / self.size[0]
        p1 = parents[0] - DISCOUNT[1] * parents[1] + self.strength[1][parent] * p0[row]
        return p0, p1 / self.size[1][parent]


_SLOTS = 1 + PARENTS + N_LEAVES


def _add_up(totals: Totals | None, turn: int):
    """Customers and tables of the restaurants over a task's words, seated once (no totals) or sampled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _SLOTS))
        for lot in _lots(batches):
            rows = _Rows(lot)
            means = rows.sample(totals, 1 if totals else 0, _generator(lot, turn))
            slots = np.zeros(rows.n, np.int64), 1 + rows.parent, 1 + PARENTS + rows.leaf
            for at, level in zip(slots, means):
                for i in (0, 1):
                    sums[i] += np.bincount(at, level[i], _SLOTS)
        used = np.flatnonzero(sums[0])
        arrays = [pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])]
        yield pa.RecordBatch.from_arrays(arrays, ["slot", "customers", "tables"])

    return run


def _generator(lot: pa.Table, turn: int) -> np.random.Generator:
    """The same numbers whenever a task is run again."""
    return np.random.default_rng([turn, crc32(lot.column("word")[0].as_py().encode()), lot.num_rows])


def _single(values: np.ndarray) -> np.ndarray:
    """The values in single precision, rounded down: no restaurant serves its words more than it has."""
    near = values.astype(np.float32)
    return np.where(near > values, np.nextafter(near, np.float32(0)), near)


def _learn(totals: Totals, turn: int):
    """What a word is served for by its own customers in each restaurant, on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            rows = _Rows(lot)
            own = [c - d * t for (c, t), d in zip(rows.sample(totals, ROUNDS, _generator(lot, turn)), DISCOUNT)]
            arrays = [
                lot.column("word").combine_chunks(), pa.array(np.add.reduceat(rows.customers, rows.starts[:-1])),
                pa.array(own[0]), _binaries(rows.parent.astype(np.uint8), rows.parent_starts),
                _binaries(_single(own[1]), rows.parent_starts), _binaries(rows.leaf.astype(np.uint16), rows.starts),
                _binaries(_single(own[2]), rows.starts),
            ]
            yield pa.RecordBatch.from_arrays(arrays, _MODEL)

    return run


_MODEL = ["word", "count", "root", "parents", "parent_own", "leaves", "leaf_own"]


def _own_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(_SLOTS)
    for lot in _lots(batches):
        sums[0] += lot.column("root").to_numpy().sum()
        at = 1 + _joined(lot.column("parents"), np.uint8)[0].astype(np.int64)
        sums += np.bincount(at, _joined(lot.column("parent_own"), np.float32)[0], _SLOTS)
        at = 1 + PARENTS + _joined(lot.column("leaves"), np.uint16)[0].astype(np.int64)
        sums += np.bincount(at, _joined(lot.column("leaf_own"), np.float32)[0], _SLOTS)
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["slot", "own"])


class Shares:
    """The size of each restaurant and the share that it leaves to its parent, so that probabilities add up to 1.

    The customers of leaves are given; those above are the tables below, which follow from what the last pass serves:
    customers less the discount of each table. So each restaurant has room for its own words and leaves some.
    """

    def __init__(self, totals: Totals, own: np.ndarray):
        self.base = totals.base
        levels = own[:1], own[1 : 1 + PARENTS], own[1 + PARENTS :]
        customers = [np.zeros(0)] * 2 + [totals.size[2] - STRENGTH[2]]
        customers[1] = ((customers[2] - levels[2]) / DISCOUNT[2]).reshape(PARENTS, LEAVES).sum(axis=1)
        customers[0] = ((customers[1] - levels[1]) / DISCOUNT[1]).sum(keepdims=True)
        self.size = np.concatenate([c + s for c, s in zip(customers, STRENGTH)])
        self.rest = (self.size - own) / self.size

    def probabilities(self, lot: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each word that is asked for in the restaurants it is asked for, and how many there are of each word."""
        asked, sizes = _joined(lot.column("asked"), np.uint16)
        asked, row = asked.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        root = pc.fill_null(lot.column("root"), 0.0).to_numpy()
        p0 = root / self.size[0] + self.rest[0] * self.base
        p1 = self._own(lot, "parents", "parent_own", np.uint8, row, asked // LEAVES, 1) + self.rest[1 + asked // LEAVES] * p0[row]
        slot = 1 + PARENTS
        return self._own(lot, "leaves", "leaf_own", np.uint16, row, asked, slot) + self.rest[slot + asked] * p1, sizes

    def _own(self, lot, names: str, values: str, kind: type, row: np.ndarray, at: np.ndarray, slot: int) -> np.ndarray:
        ids, sizes = _joined(lot.column(names), kind)
        keys = np.repeat(np.arange(len(sizes)), sizes) << 16 | ids
        wanted = row << 16 | at
        if not len(keys):
            return np.zeros(len(wanted))
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        own = np.where(keys[place] == wanted, _joined(lot.column(values), np.float32)[0][place].astype(float), 0.0)
        return own / self.size[slot + at]


def _answers(shares: Shares):
    """A row for each slice in a lot: the words' numbers, training counts, and probabilities where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            order = np.argsort(lot.column("slice").to_numpy(), kind="stable")
            lot = lot.take(pa.array(order)).combine_chunks()
            probabilities, sizes = shares.probabilities(lot)
            slices = lot.column("slice").to_numpy()
            starts = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), len(slices))
            ends = np.append(0, np.cumsum(sizes))
            counts = pc.fill_null(lot.column("count"), 0).to_numpy()
            values = lot.column("number").to_numpy(), counts & 0xFFFFFFFF, counts >> 32
            packed = [[_packed(v[i:j]) for i, j in zip(starts, starts[1:])] for v in values]
            chances, ends = probabilities.astype(np.float32).view(np.uint32), ends[starts]
            packed.append([_packed(chances[i:j]) for i, j in zip(ends, ends[1:])])
            arrays = [pa.array(slices[starts[:-1]]), *(pa.array(p, pa.binary()) for p in packed)]
            yield pa.RecordBatch.from_arrays(arrays, ["slice", "numbers", "low", "high", "probabilities"])

    return run


def _scores(n_tokens: int, n_words: int):
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in slices.to_pylist():
            s = _Slice(row)
            keys, at = np.unique(s.key, return_inverse=True)
            starts = np.searchsorted(keys >> 16, np.arange(len(s.words) + 1))
            count, logs = np.zeros(len(s.words), np.int64), np.zeros(len(keys))
            for part in answers.to_pylist():
                numbers = _unpacked(part["numbers"]).astype(np.int64)
                count[numbers] = _unpacked(part["low"]).astype(np.int64) | _unpacked(part["high"]).astype(np.int64) << 32
                sizes = starts[numbers + 1] - starts[numbers]
                first = np.cumsum(sizes) - sizes
                places = np.repeat(starts[numbers] - first, sizes) + np.arange(sizes.sum())
                logs[places] = np.log10(_unpacked(part["probabilities"]).view(np.float32))
            begins = np.cumsum(s.lengths) - s.lengths
            base = np.log10((count + 1) / (n_tokens + n_words + 1))[s.word]
            arrays = [
                pa.array(row["doc_ids"], slices.schema.field("doc_ids").type.value_type), pa.array(~s.train), pa.array(s.lengths),
                pa.array(np.add.reduceat((count > 0)[s.word].astype(np.int64), begins)),
                pa.array(np.full(len(s.train), n_tokens, np.int64)), pa.array(np.add.reduceat(base, begins)),
                pa.array(np.add.reduceat(logs[at], begins)),
            ]
            tables.append(pa.Table.from_arrays(arrays, _RESULT))
        return pa.concat_tables(tables)

    return run


_RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _totals(sums: DataFrame, n_words: int) -> Totals:
    rows = sums.groupBy("slot").agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).toArrow()
    both = np.zeros((2, _SLOTS))
    for i, name in enumerate("ct"):
        both[i, rows.column("slot").to_numpy()] = rows.column(name).to_numpy()
    levels = [[x[0], x[1 : 1 + PARENTS], x[1 + PARENTS :]] for x in both]
    return Totals(*levels, n_words)


def language_model_scores(docs: DataFrame, train: Column) -> DataFrame:
    """Log10 probability of each text by a model of the documents for which `train` holds, and by their word counts.

    Columns: doc_id, held_out (not learned from), n_tokens (words and the end), n_known (tokens met in training),
    train_tokens, base_score (by counts plus one), score (by the model).
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    schema = f"slice long, doc_ids array<{kind}>, train binary, lengths binary, words binary, tokens binary"
    slices = write_once(docs.mapInArrow(_slices, schema))
    sequences = slices.drop("doc_ids")
    counts = sequences.mapInArrow(_train_counts, "word string, leaves binary, counts binary")
    words = counts.repartition("word").sortWithinPartitions("word")
    sums = "slot long, customers double, tables double"
    learned = "word string, count long, root double, parents binary, parent_own binary, leaves binary, leaf_own binary"
    answered = "slice long, numbers binary, low binary, high binary, probabilities binary"
    with ExitStack() as tables:
        with stored(words.mapInArrow(_merge, "word string, leaves binary, counts binary")) as words:
            n_words = words.count()
            totals = _totals(words.mapInArrow(_add_up(None, 0), sums), n_words)
            n_tokens = round(float(np.sum(totals.size[2] - STRENGTH[2])))
            for turn in range(1, PASSES):
                totals = _totals(words.mapInArrow(_add_up(totals, turn), sums), n_words)
            model = tables.enter_context(stored(words.mapInArrow(_learn(totals, PASSES), learned)))
        own = np.zeros(_SLOTS)
        sums = model.mapInArrow(_own_sums, "slot long, own double").groupBy("slot").agg(F.sum("own").alias("own"))
        rows = sums.toArrow()
        own[rows.column("slot").to_numpy()] = rows.column("own").to_numpy()
        questions = sequences.mapInArrow(_questions, "word string, slice long, number long, asked binary")
        met = questions.join(model, "word", "left").drop("word")
        answers = write_once(met.mapInArrow(_answers(Shares(totals, own)), answered))
    result = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scores(n_tokens, n_words), result)

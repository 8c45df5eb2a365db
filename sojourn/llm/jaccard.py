"""Near copies: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

The candidates come from adaptive multi-match prefixes (Wang, Li and Feng, 2012). All documents order
their n-grams alike, rare ones first. Of two sets that are similar enough, the first n - ceil(t n) + k
n-grams of each share at least k, for any k. A document picks the k with the least estimated cost from
the frequencies of its own prefix: a longer prefix costs postings, but more shared n-grams are asked for
before a pair is verified.

Equal sets are one node from the start. Then two rounds look for links: the first compares each node
with the head of one of its postings lists only, and joins what is linked into components; the second
compares all candidate pairs that still lie in different components. A group of thousands of near copies
is thus mostly linked by star-shaped comparisons, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import bounds, prepare, span_hashes, text_slices, word_hashes, words_of
from sojourn.llm.components import components
from sojourn.session import stored, write_once

#: Counters of the frequency sketch, as a power of two: 4 MB, whatever the input.
SKETCH_BITS = 20
#: Bits of the table of wanted sets, as a power of two: 1 MB, whatever the input.
WANTED_BITS = 23
_BLOCKS = 64
#: Most shared n-grams that a document may ask for.
MOST_SHARED = 6
#: Cost of verifying a candidate, where reading one posting costs 1.
VERIFY_COST = 8
#: Other documents that share an n-gram which isn't among the frequent ones.
ORDINARY = 0.25


def combined(rows: DataFrame, start: np.ndarray, fold: Callable, combine: np.ufunc) -> np.ndarray:
    """An array of fixed size that `fold(array, batch)` fills in each task; the tasks' arrays are combined."""
    kind = "block int, data binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start.copy()
        for batch in batches:
            fold(total, batch)
        blocks = [zlib.compress(b.tobytes(), 1) for b in np.split(total, _BLOCKS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "data"]
        )

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.split(start, _BLOCKS)[0].copy()
        for batch in batches:
            for data in batch.column("data").to_pylist():
                combine(total, np.frombuffer(zlib.decompress(data), start.dtype), out=total)
        data = zlib.compress(total.tobytes(), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"]
        )

    parts = rows.mapInArrow(fill, kind).groupBy("block").applyInArrow(merge, kind).collect()  # _BLOCKS rows
    found = {r["block"]: np.frombuffer(zlib.decompress(r["data"]), start.dtype) for r in parts}
    return np.concatenate([found[i] for i in range(_BLOCKS)]) if found else start


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; A-Z are lower-cased.

    A text with fewer words has its whole sequence as the only n-gram; one without words has none.
    """
    words = words_of(texts)
    hashes = word_hashes(words, fold=True)
    n = np.diff(words.first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    owner = np.repeat(np.arange(len(n)), count)
    starts = words.first[owner] + np.arange(first[-1]) - first[owner]
    grams = span_hashes(hashes, starts, np.minimum(starts + width, words.first[owner + 1]))
    for _, a, b in bounds(first):
        yield np.unique(grams[a:b])


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have an n-gram of each hash bucket: exact counts over all documents."""

    def count(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, texts in text_slices([batch]):
            buckets = np.concatenate(list(shingle_sets(texts, width))) >> np.uint64(64 - SKETCH_BITS)
            total += np.bincount(buckets.astype(np.int64), minlength=len(total)).astype(total.dtype)

    return combined(docs.select("text"), np.zeros(1 << SKETCH_BITS, np.uint64), count, np.add)


def choose_prefix(grams: np.ndarray, sketch: np.ndarray, mean: float, percent: int) -> tuple[int, np.ndarray]:
    """How many shared n-grams a document asks for, and its prefix in the common order; `mean` is the sketch's."""
    n = len(grams)
    load = sketch[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(load, kind="stable")  # equal loads stay in order of the hashes
    needed = -(-percent * n // 100)
    most = min(MOST_SHARED, needed)
    # what a bucket holds beyond its share and three standard deviations belongs to a frequent n-gram
    load = load[order[: n - needed + most]]
    others = (np.maximum(load - (mean + 3 * mean**0.5), 0) + ORDINARY).cumsum()
    shared = np.arange(1, most + 1)
    length = n - needed + shared
    cost = length + others[length - 1] * (1 + VERIFY_COST / shared)
    best = int(np.argmin(cost))
    return best + 1, grams[order[: length[best]]]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set), asked, prefix."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = sketch.value
        mean = float(loads.mean())
        for part, texts in text_slices(batches):
            size, node, asked, prefix = [], [], [], []
            for grams in shingle_sets(texts, width):
                k, tokens = choose_prefix(grams, loads, mean, percent) if len(grams) else (0, grams)
                size.append(len(grams))
                node.append(_node(grams) if len(grams) else None)
                asked.append(k)
                prefix.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(asked, pa.int32()),
                    pa.array(prefix, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "asked", "prefix"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, node long, asked int, prefix array<long>"
    )


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, grams) of the wanted nodes, and of a few others, from one scan that shuffles no text."""

    def mark(total: np.ndarray, batch: pa.RecordBatch) -> None:
        bit = batch.column(0).to_numpy() & ((1 << WANTED_BITS) - 1)
        np.bitwise_or.at(total, bit >> 3, (1 << (bit & 7)).astype(np.uint8))

    marks = combined(wanted, np.zeros(1 << WANTED_BITS >> 3, np.uint8), mark, np.bitwise_or)
    table = docs.sparkSession.sparkContext.broadcast(marks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            found = {}
            for grams in shingle_sets(texts, width):
                if len(grams):
                    node = _node(grams)
                    bit = node & ((1 << WANTED_BITS) - 1)
                    if table.value[bit >> 3] >> (bit & 7) & 1:
                        found[node] = grams.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["node", "grams"]
            )

    read_sets = docs.select("text").mapInArrow(read, "node long, grams binary")
    return read_sets.groupBy("node").agg(F.first("grams").alias("grams"))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, written.

    The sets of b join where their copies were just made one; those of a, of which there are fewer, come
    from a written table, so that Spark can split the pairs of a head that has many.
    """
    left = _sets(docs, pairs.select("a").distinct(), width)
    right = _sets(docs, pairs.select("b").distinct(), width).toDF("b", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with stored(left) as sets:
        both = pairs.join(right, "b").join(sets.toDF("a", "left"), "a").select("a", "b", "left", "right")
        return write_once(both.mapInArrow(compare, "a long, b long"))


def _common(percent: int, x: str, y: str) -> str:
    """How many n-grams similar sets share at least."""
    return f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent})"


def _close(percent: int, x: str, y: str) -> str:
    """Sizes allow the threshold, and both postings lie where the first of the n-grams asked for have to be.

    Similar sets share at least `common` n-grams. Behind the k-th shared one are common - k others, so its
    position in a set of n is below n - common + k.
    """
    common = _common(percent, x, y)
    asked = f"least({x}.asked, {y}.asked)"
    return (
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) "
        f"AND {x}.pos < {x}.n - {common} + {asked} AND {y}.pos < {y}.n - {common} + {asked}"
    )


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes in different components that share as many n-grams in their prefixes as asked.

    The last of the k shared n-grams asked for has k listed ones up to it in either prefix, so pairs meet at
    n-grams with k listed before or there. That leaves out documents whose prefix is mostly their own, before
    any pair is made. Then the n-grams that a pair's prefixes share are counted.
    """
    x, y = lists.alias("x"), lists.alias("y")
    asked = "least(x.asked, y.asked)"
    met = (
        x.join(
            y,
            F.expr(
                f"x.token = y.token AND x.node < y.node AND x.root <> y.root AND {_close(percent, 'x', 'y')} "
                f"AND x.listed >= {asked} AND y.listed >= {asked}"
            ),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )
    prefixes = lists.groupBy("node").agg(
        F.first("n").alias("n"), F.first("asked").alias("asked"), F.collect_list(F.struct("pos", "token")).alias("prefix")
    )
    both = (
        met.join(prefixes.select(F.col("node").alias("a"), F.struct("n", "asked", "prefix").alias("x")), "a")
        .join(prefixes.select(F.col("node").alias("b"), F.struct("n", "asked", "prefix").alias("y")), "b")
    )

    def reach(p: str) -> str:
        limit = f"{p}.n - {_common(percent, 'x', 'y')} + {asked}"
        return f"transform(filter({p}.prefix, t -> t.pos < {limit}), t -> t.token)"

    return both.where(f"size(array_intersect({reach('x')}, {reach('y')})) >= {asked}").select("a", "b")


def similarity_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable by links).

    Documents link when 100 * |intersection| >= percent * |union|. A null or empty text has an empty set and
    is linked with nothing; its component is its own id. A null id is like any id, but it is no component's
    smallest unless it is alone. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    with ExitStack() as tables:
        parts = tables.enter_context(ExitStack())
        with stored(signatures(docs, width, percent)) as signed:
            members = tables.enter_context(stored(signed.select("doc_id", "n_shingles", "node")))
            nodes = parts.enter_context(stored(_nodes(signed)))
        members = members.join(_roots(docs, nodes, parts, width, percent), "node", "left")
        members = write_once(members.withColumn("root", F.coalesce("root", "node")).drop("node"))
    smallest = write_once(members.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")))
    return members.join(smallest, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )


def _roots(docs: DataFrame, nodes: DataFrame, read: ExitStack, width: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that are linked with another one; `read` holds their table, which goes when it was read."""
    with ExitStack() as tables:
        with ExitStack() as early:
            with read as parts:
                lists = early.enter_context(stored(_lists(nodes, percent, parts)))
            with ExitStack() as parts:
                stars = early.enter_context(stored(_stars(lists, percent, parts)))
            links = _verified(stars, docs, width, percent)
            part = components(links)

            # round 2: all candidates in different components
            placed = lists.join(part, "node", "left").select(
                "token", "node", "n", "asked", "pos", F.coalesce("root", "node").alias("root")
            )
            mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
            mixed = early.enter_context(stored(mixed.select("token")))
            by_place = Window.partitionBy("node").orderBy("pos")  # a document's own prefix
            open_lists = placed.join(mixed, "token", "left_semi").withColumn("listed", F.row_number().over(by_place))
            open_lists = tables.enter_context(stored(open_lists))
        pairs = tables.enter_context(stored(_candidates(open_lists, percent)))
        return components(links.union(_verified(pairs, docs, width, percent)))


def _nodes(signed: DataFrame) -> DataFrame:
    """(node, n, asked, prefix): each set once."""
    return (
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.first("n_shingles").cast("int").alias("n"),
            F.first("asked").alias("asked"),
            F.first("prefix").alias("prefix"),
        )
    )


def _lists(nodes: DataFrame, percent: int, parts: ExitStack) -> DataFrame:
    """(token, node, n, asked, pos, central): the postings of n-grams that several prefixes hold; reads `parts`.

    A node with fewer shared n-grams than it or any possible partner asks for is in no pair and left out.
    `central` says how common a node's prefix is.
    """
    postings = nodes.select("node", "n", "asked", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("df"), F.min("asked").alias("weakest")).where("df > 1")
    shared = parts.enter_context(stored(shared))
    lists = parts.enter_context(stored(postings.join(shared, "token")))
    able = (
        lists.groupBy("node")
        .agg(
            F.count("*").alias("shared"),
            F.min(F.least("asked", "weakest")).alias("least"),
            (F.sum("df") / F.expr(f"first(n) - ceil({percent} * first(n) / 100) + first(asked)")).alias("central"),
        )
        .where("shared >= least")
    )
    able = parts.enter_context(stored(able.select("node", "central")))
    return lists.join(able, "node").select("token", "node", "n", "asked", "pos", "central")


def _stars(lists: DataFrame, percent: int, parts: ExitStack) -> DataFrame:
    """Round 1, (a, b): each node b with the head a of a list, the one that it shares the most n-grams with.

    The head of a list is the node whose prefix is the most common: a text that copies differ from, rather than a
    changed copy. The heads are read from `parts`.
    """
    head = F.max_by(F.struct("node", "n", "asked", "pos"), F.struct("central", "node")).alias("x")
    heads = parts.enter_context(stored(lists.groupBy("token").agg(head)))
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    return (
        lists.alias("y")
        .join(heads, "token")
        .where(f"x.node <> y.node AND {_close(percent, 'x', 'y')}")
        .groupBy(F.col("y.node").alias("b"), F.col("x.node").alias("a"))
        .agg(F.count("*").alias("shared"), F.first(F.expr("least(x.asked, y.asked)")).alias("asked"))
        .where("shared >= asked")
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select("a", "b")
    )

"""What the document operators share: session settings, bounded batches of text, words and their hashes."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sojourn
from sojourn.session import tune

#: Rows in an Arrow batch, so that a batch of long texts fits in a worker's memory.
BATCH_ROWS = 256
#: Bytes of text that are worked on at once, unless a single text is longer.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on, and send this package to the Python workers, once per session."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    archive = f"{SparkFiles.getRootDirectory()}/packages/sojourn"  # Spark removes this folder at its end
    if not os.path.exists(f"{archive}.zip"):
        package = Path(sojourn.__file__).parent
        os.makedirs(os.path.dirname(archive), exist_ok=True)
        shutil.make_archive(archive, "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(f"{archive}.zip")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal digits, mod n: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % n


def release_unused() -> None:
    """Give memory that Arrow keeps for later back to the system; a worker may wait long, or work without Arrow."""
    pa.default_memory_pool().release_unused()


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about `limit` bytes of text each, and their texts with null as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop
    release_unused()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and where each text begins and the last one ends."""
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes of words: all but ASCII white space.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words without punctuation: ASCII letters and digits, and all bytes beyond ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Words:
    """Words of several texts in a row: word i has the bytes starts[i] to ends[i], text j the words first[j] to first[j + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(texts: pa.Array, members: np.ndarray = NOT_SPACE) -> Words:
    data, offsets = utf8(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = members[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = True, True
    starts = np.flatnonzero(inside & before)
    return Words(data, starts, np.flatnonzero(inside & after) + 1, np.searchsorted(starts, offsets))


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse mod 2^64, raised to 0, 1, ..., n."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _POWERS[0] = (tables[0], tables[1])
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[starts[i]:ends[i]], from sums over all values; the place doesn't matter."""
    powers, inverse = _powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], dtype=np.uint64, out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096


def word_hashes(words: Words, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the words' bytes, or of those with ASCII letters in lower case.

    Eight bytes at a time go through :func:`mix`, so patterns within a word do not cancel out; words of up to eight
    bytes and the same length never share a hash.
    """
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[:-8] = _LOWER[words.data] if fold else words.data
    eight = np.ndarray(len(words.data) + 1, "<u8", padded, strides=(1,))
    size = words.ends - words.starts
    hashes = size.astype(np.uint64) * np.uint64(BASE)
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        rest = size[at] - done
        chunk = eight[words.starts[at] + done] & _FIRST[np.minimum(rest, 8)]
        hashes[at] = mix(hashes[at] * np.uint64(0xD6E8FEB86659FD93) ^ chunk)
        done += 8
        at = at[rest > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = blake2b(padded[words.starts[i] : words.ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def bounds(first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of each text's words."""
    edges = first.tolist()
    return zip(range(len(edges) - 1), edges, edges[1:])

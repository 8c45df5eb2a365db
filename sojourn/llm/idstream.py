"""Token ids of documents in compressed binary blocks.

A file is a Parquet table with a row for each segment: whole documents in ascending order of their id, and
the blocks that hold their token ids. Each block stands alone: it can be decoded without any other, and a
checksum covers its ids.

    block    b"CMRC", varint n (ids), varint d (distinct ids), d varints (gaps between the ascending distinct
             ids), d varints (how often each occurs), little-endian 32-bit words of the range coder, and the
             little-endian crc32 of the ids as 32-bit words
    coder    64-bit range coder with 32-bit output words; it starts with low 0 and range 2^64 - 1

A model predicts each id of a block from what came before in the block. Order 0 are the block's counts. Order
1 and order 2 remember, for the last id and for the last two, which id followed most recently and how often
in a row that held. The share of such predictions that came true so far, at that order and run length, sets
the weight in the mixture. All weights are integers, so encoder and decoder agree exactly.

Many blocks are coded side by side: a step handles one id of each block in numpy arrays.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from sojourn.llm.common import prepare, release_unused, text_slices, utf8
from sojourn.session import scratch_path, shuffles_removed, write_once

MAGIC = b"CMRC"
#: Ids of a block.
BLOCK_IDS = 4096
#: A segment ends with the document that fills so many ids.
SEGMENT_IDS = 16 * BLOCK_IDS
#: Blocks that are coded side by side.
LANES = 2048
#: Pieces of texts whose ids a worker remembers; it holds some more than twice as many at most.
MEMO_PIECES = 150_000
#: Bytes of text that are split into pieces at once, so that few pieces are looked up again and again.
TEXT_BYTES = 2 << 20
#: Marks that make one piece of a text with others of their kind.
_MARKS = ".,;:!?*#$%&()+-/=@[]_{}~"
_RUN = 7  # longest run that counts, in 3 bits
#: Weight of a prediction against all of order 0, by its share of hits in 1024 steps: 256 p / (1 - p), at most 64 times.
_ODDS = np.minimum(256 * np.arange(1024) // (1024 - np.arange(1024)), 64 * 256).astype(np.int32)
_WORD = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_TOP = np.uint64(1 << 32)
_ONE, _FIVE = np.uint64(1), np.uint64(5)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first; all but a number's last byte have the high bit. And the bytes of each."""
    values = values.astype(np.int64)
    size = np.maximum(1, sum((values >> 7 * i > 0).astype(np.int64) for i in range(5)))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(5):
        long = np.flatnonzero(size > i)
        out[at[long] + i] = values[long] >> 7 * i & 127 | (size[long] > i + 1) << 7
    return out, size


def _heads(found: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> list[bytes]:
    """What stands before the coder's words, of blocks of some sizes with some distinct ids and counts."""
    out = []
    for i in range(0, len(found), 64):
        some = found[i : i + 64]
        parts = [x for n, (ids, counts) in zip(sizes[i:], some) for x in ((n, len(ids)), np.diff(ids, prepend=0), counts)]
        values, size = _varints(np.concatenate(parts))
        ends = np.append(0, np.cumsum(size))[np.cumsum([0, *(2 + 2 * len(ids) for ids, _ in some)])].tolist()
        out += [MAGIC + values[a:b].tobytes() for a, b in zip(ends, ends[1:])]
    return out


def _read_varints(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    if n == 0:
        return np.zeros(0, np.int64), at
    raw = np.frombuffer(data, np.uint8, offset=at)
    last = np.flatnonzero(raw[: 10 * n] < 128)[:n]
    if len(last) < n:
        raise ValueError("a block ends within its header")
    begin = np.concatenate(([0], last[:-1] + 1))
    values = raw[begin].astype(np.int64) & 127
    size, i = last - begin, 1
    long = np.flatnonzero(size)
    while len(long):
        values[long] += (raw[begin[long] + i].astype(np.int64) & 127) << 7 * i
        i += 1
        long = long[size[long] >= i]
    return values, at + int(last[-1]) + 1


def _spread(counts: list[np.ndarray], width: int) -> np.ndarray:
    """Where each symbol of a block begins among the block's sorted ids and how often it occurs, packed; a row a block.

    Both are times 4, as order 0 has in the mixture.
    """
    spread = np.zeros((len(counts), width), np.int32)
    for i, c in enumerate(counts):
        spread[i, : len(c)] = (np.cumsum(c) - c) << 17 | c << 2
    return spread.ravel()


def _shares(n: int) -> np.ndarray:
    """Share of predictions that came true, of 2^16, for each lane, order and run; 0 where the run is 0."""
    return np.tile(np.repeat(np.array([0, 1 << 15], np.int32), [1, 7]), 2 * n)


def _second(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where order 2 remembers what follows two symbols."""
    return last * 2053 + before * 3 & BLOCK_IDS - 1


def _remembered(slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """What the slot of each symbol's context predicts: its run (0 if it is empty) | 8 if it is right | 16 if too small.

    Rows are blocks. A stable sort by slot puts each symbol after the one that its slot holds.
    """
    n, steps = symbols.shape
    order = np.argsort(slots, axis=1, kind="stable")
    order += steps * np.arange(n)[:, None]
    order = order.ravel()
    slots, symbols = slots.ravel().take(order).reshape(n, steps), symbols.ravel().take(order).reshape(n, steps)
    held = slots[:, 1:] == slots[:, :-1]
    hit = np.zeros((n, steps), bool)
    np.equal(symbols[:, 1:], symbols[:, :-1], out=hit[:, 1:])
    hit[:, 1:] &= held
    at = np.arange(steps, dtype=np.int16)
    run = at - np.maximum.accumulate(np.where(hit, np.int16(0), at), axis=1)
    run = np.minimum(run, np.int16(_RUN - 1)).astype(np.uint8) + np.uint8(1)  # once the symbol has come
    found = hit.view(np.uint8) << np.uint8(3)
    found[:, 1:] |= run[:, :-1] * held
    found[:, 1:] |= (symbols[:, :-1] < symbols[:, 1:]).view(np.uint8) << np.uint8(4)
    out = np.empty(n * steps, np.uint8)
    out[order] = found.ravel()
    return out.reshape(n, steps)


def _longest_first(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of blocks by falling size, and how many blocks have a step i, for each i."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max()) if len(sizes) else 0
    return order, np.searchsorted(-sizes[order], -np.arange(steps), side="left")


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending distinct ids of a block, each id's number among them, and how often each occurs."""
    if not len(ids) or ids.max() >= 1 << 16:
        return np.unique(ids, return_inverse=True, return_counts=True)
    ordered = np.sort(ids.astype(np.uint16), kind="stable")
    new = np.empty(len(ids), bool)
    new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    found = ordered[begin]
    number = np.empty(int(found[-1]) + 1, np.int16)
    number[found] = np.arange(len(found))
    return found.astype(np.int64), number.take(ids), np.diff(begin, append=len(ids))


def _turn(rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Lanes by steps to steps by lanes, or back, a few at a time as the memory is read and written in lines."""
    for i in range(0, len(rows), 64):
        out[:, i : i + 64] = rows[i : i + 64].T
    return out


def _groups(n: int) -> list[tuple[int, int]]:
    """Blocks that are coded together, about LANES each, and no few at the end."""
    edges = np.linspace(0, n, max(1, round(n / LANES)) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:])) if n else []


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK_IDS ids as bytes."""
    out: list[bytes] = []
    for i, j in _groups(len(blocks)):
        out += _encode(blocks[i:j])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """All symbols are known, so what the model remembers of each is found by sorting; shares and the coder go by steps."""
    order, active = _longest_first(np.array([len(b) for b in blocks]))
    sizes = np.array([len(blocks[i]) for i in order])
    lanes, steps = len(order), len(active)
    found, symbols = [], np.empty((steps, lanes), np.int16)
    entries = np.empty((steps, 2, lanes), np.uint8)
    for a in range(0, lanes, 64):
        rows = np.zeros((min(64, lanes - a), steps), np.int16)
        for row, i in zip(rows, order[a : a + 64].tolist()):
            ids, row[: len(blocks[i])], counts = _distinct(blocks[i])
            found.append((ids, counts))
        last, before = np.zeros_like(rows), np.zeros_like(rows)
        last[:, 1:], before[:, 2:] = rows[:, :-1], rows[:, :-2]
        symbols[:, a : a + 64] = rows.T
        entries[:, 0, a : a + 64] = _remembered(last, rows).T
        entries[:, 1, a : a + 64] = _remembered(_second(last, before), rows).T
    width = max([1, *(len(ids) for ids, _ in found)])
    spread, share = _spread([counts for _, counts in found], width), _shares(lanes)
    base, kinds = np.arange(lanes) * width, np.arange(lanes) * 16 + np.array([[0], [8]])
    mass = (sizes << 2).astype(np.int32)
    low = np.zeros(lanes, np.uint64)
    size = np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, steps * 11 // 16 + 8), np.uint32)  # an id takes less than 22 bits
    filled = np.arange(lanes) * words.shape[1]
    code = words.ravel()

    def carry(at: np.ndarray) -> None:
        """Add 1 to words, each once at most, as the range after a carry lies below the next."""
        while len(at):
            code[at] += 1
            at = at[code[at] == 0] - 1

    ends = np.union1d(np.flatnonzero(np.diff(active)) + 1, [*range(0, steps, 16), steps]).tolist()
    for a, b in zip(ends, ends[1:]):
        n = int(active[a])
        symbol = symbols[a:b, :n]
        entry = entries[a:b, :, :n].astype(np.int32)
        kind = kinds[:, :n] + (entry & _RUN)
        hit, less = entry >> 3 & 1, entry >> 4
        came = hit * np.int32(65535)
        old = np.empty(kind.shape, np.int32)
        for i in range(b - a):
            share.take(kind[i], out=old[i], mode="clip")
            change = came[i] - old[i]
            change >>= 5
            change += old[i]
            share[kind[i]] = change
        weight = _ODDS.take(old >> 6)
        weight *= mass[:n]
        weight >>= 8
        total = (mass[:n] + weight[:, 0] + weight[:, 1]).astype(np.uint64)
        own = spread.take(base[:n] + symbol)
        part = weight * hit
        wide = ((own & 32767) + part[:, 0] + part[:, 1]).astype(np.uint64)
        np.multiply(weight, less, out=part)
        begin = ((own >> 15) + part[:, 0] + part[:, 1]).astype(np.uint64)
        now, left = low[:n], size[:n]
        over, full, word = np.empty((b - a, n), bool), np.empty((b - a, n), bool), np.empty((b - a, n), np.uint64)
        for i in range(b - a):
            left //= total[i]
            start = begin[i]
            start *= left
            now += start
            np.less(now, start, out=over[i])
            left *= wide[i]
            np.less(left, _TOP, out=full[i])
            np.right_shift(now, _WORD, out=word[i])
            shift = full[i].astype(np.uint64)
            shift <<= _FIVE
            now <<= shift
            left <<= shift
        at = np.cumsum(full, axis=0)
        at += filled[:n]
        filled[:n] = at[-1]
        at -= full
        put = np.flatnonzero(full)
        code[at.take(put)] = word.take(put)
        carry(at.take(np.flatnonzero(over)) - 1)
    # the last word: a multiple of 2^32 within the range that is left
    last = (low + _LOW) & ~_LOW
    carry(filled[last < low] - 1)
    code[filled] = last >> _WORD
    del symbols, entries
    filled += 1 - np.arange(lanes) * words.shape[1]
    out: list[bytes] = [b""] * len(blocks)
    for lane, (i, head) in enumerate(zip(order.tolist(), _heads(found, sizes))):
        check = zlib.crc32(blocks[i].astype("<u4").tobytes()).to_bytes(4, "little")
        out[i] = head + words[lane, : filled[lane]].astype("<u4").tobytes() + check
    return out


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is no block or fails its checksum raises ValueError."""
    out: list[np.ndarray] = []
    for i, j in _groups(len(coded)):
        out += _decode(coded[i:j])
    return out


def _decode(coded: list[bytes]) -> list[np.ndarray]:
    heads = []
    for data in coded:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block")
        (n, distinct), at = _read_varints(data, len(MAGIC), 2)
        both, at = _read_varints(data, at, 2 * int(distinct))
        gaps, counts = np.split(both, 2)
        heads.append((int(n), np.cumsum(gaps), counts, np.frombuffer(data[at:-4], "<u4")))
    order, active = _longest_first(np.array([h[0] for h in heads]))
    heads = [heads[i] for i in order]
    sizes = np.array([h[0] for h in heads])
    owners = np.zeros((len(heads), BLOCK_IDS), np.int16)
    length = max(len(h[3]) for h in heads) + 2
    words = np.zeros(len(heads) * length + len(active), np.uint32)
    for lane, (n, _, counts, code) in enumerate(heads):
        owners[lane, :n] = np.repeat(np.arange(len(counts), dtype=np.int16), counts)
        words[lane * length : lane * length + len(code)] = code
    symbols = _symbols([h[2] for h in heads], sizes, active, owners.ravel(), words, np.arange(len(heads)) * length)
    rows = _turn(symbols, np.empty(symbols.shape[::-1], np.int16))
    del symbols, words, owners
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for lane, i in enumerate(order.tolist()):
        n, ids, _, _ = heads[lane]
        out[i] = ids.astype(np.uint32).take(rows[lane, :n]) if n else np.zeros(0, np.uint32)
        if zlib.crc32(out[i].astype("<u4").tobytes()) != int.from_bytes(coded[i][-4:], "little"):
            raise ValueError("a block fails its checksum")
    return out


def _symbols(
    counts: list[np.ndarray], sizes: np.ndarray, active: np.ndarray, owners: np.ndarray, words: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """The symbols of blocks, a row for each step; `owners` holds the symbol of each place of order 0.

    Arrays of two rows hold order 1 and order 2. Truth is -1 or 0 in 32 bits, so that numpy needs no other types.
    """
    lanes = len(sizes)
    out = np.zeros((2 + len(active), lanes), np.int16)  # nothing comes before the first
    width = max([1, *map(len, counts)])
    spread, share = _spread(counts, width), _shares(lanes)
    table = np.zeros(lanes * (width + BLOCK_IDS), np.int16)
    state = {
        "base": np.arange(lanes) * width,
        "second": np.arange(lanes) * BLOCK_IDS + lanes * width,
        "kinds": np.arange(lanes) * 16 + np.array([[0], [8]]),
        "places": np.arange(lanes) * BLOCK_IDS,
        "end": (np.maximum(sizes, 1) - 1).astype(np.int32),
        "mass": (sizes << 2).astype(np.int32),
        "code": words.take(at).astype(np.uint64) << _WORD | words.take(at + 1),
        "size": np.full(lanes, (1 << 64) - 1, np.uint64),
        "at": at + 2,
    }
    n = -1
    for step, now in enumerate(active.tolist()):
        if now != n:
            n = now
            state = {name: x[..., :n].copy() for name, x in state.items()}
            base, second, kinds, places, end, mass, code, size, at = state.values()
            slot, difference = np.empty((2, n), np.int64), np.empty((2, n), np.int32)
        # what the orders predict, and their weights
        np.add(base, out[step + 1, :n], out=slot[0])
        np.add(_second(out[step + 1, :n], out[step, :n]), second, out=slot[1])
        entry = table.take(slot).astype(np.int32)
        guess, run = entry >> 3, entry & _RUN
        kind = kinds + run
        old = share.take(kind)
        weight = _ODDS.take(old >> 6)
        weight *= mass
        weight >>= 8
        extra = weight[0] + weight[1]
        total = (extra + mass).astype(np.uint64)
        size //= total  # a unit of the range
        total -= _ONE
        target = np.minimum(code // size, total).astype(np.int32)
        # where the predicted symbols begin and end in the mixture
        own = spread.take(base + guess)
        begin = own >> 15
        own &= 32767
        np.subtract(guess[1], guess[0], out=difference[0])
        np.negative(difference[0], out=difference[1])
        difference >>= 31  # the other order's symbol is less
        other = weight[::-1]
        begin += other & difference
        own += weight
        own += other & ~(difference[0] | difference[1])
        own += begin
        begin = target - begin >> 31
        below = target - own >> 31
        hit = begin ^ below
        below &= weight
        # the symbol, by its place in order 0 unless it is a predicted one
        extra -= below[0]
        extra -= below[1]
        target -= extra
        target >>= 2
        symbol = owners.take(np.minimum(target, end) + places).astype(np.int32)
        for i in (1, 0):
            choice = guess[i] ^ symbol
            choice &= hit[i]
            symbol ^= choice
        own = spread.take(base + symbol)
        extra += own >> 15
        own &= 32767
        weight &= hit
        own += weight[0]
        own += weight[1]
        code -= extra.astype(np.uint64) * size
        size *= own.astype(np.uint64)
        shift = (size < _TOP).astype(np.uint64)
        fresh = words.take(at).astype(np.uint64)
        fresh *= shift
        at += shift.view(np.int64)
        shift <<= _FIVE
        size <<= shift
        code <<= shift
        code |= fresh
        # what the model learns
        run &= hit
        np.negative(entry & _RUN, out=difference)
        difference >>= 31
        hit &= difference  # the share stays 0 where the run is 0
        hit &= 65535
        hit -= old
        hit >>= 5
        hit += old
        share[kind] = hit
        run += 1
        np.minimum(run, _RUN, out=run)
        run |= symbol << 3
        table[slot] = run.astype(np.int16)
        out[step + 2, :n] = symbol
    return out[2:]


#: The pre-tokenizer that keeps runs of letters and runs of marks apart, by its pattern.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def _tokenizer(path: str) -> tuple[Tokenizer, Tokenizer, np.ndarray | None]:
    """The tokenizer, its bare model for words between spaces, and which ids end a piece of a text.

    The last is None unless its pieces are runs of letters or marks in lower case.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = WhitespaceSplit()
    parts = json.loads(tokenizer.to_str())
    suffix = parts["model"].get("end_of_word_suffix")
    changes = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    splits = [x.get("pattern", x["type"]) for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if not suffix or changes != ["NFC", "Replace", "Lowercase"] or splits != [{"Regex": _PIECES}, "ByteLevel"]:
        return tokenizer, bare, None
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return tokenizer, bare, ends


class _Lately:
    """Ids of pieces, in arrays; once there are many, those not asked for since the last time go."""

    def __init__(self, limit: int):
        self.limit = limit
        self.pieces = pa.array([], pa.large_binary())
        self.ids = np.zeros(0, "<u4")
        self.sizes = np.zeros(0, np.int64)
        #: Whether a piece was there the last time and was not asked for since.
        self.before = np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.pieces)

    def __contains__(self, piece: bytes) -> bool:
        return pc.index(self.pieces, pa.scalar(piece, pa.large_binary())).as_py() >= 0

    def renew(self) -> None:
        """To be called between batches."""
        keep = ~self.before
        if np.count_nonzero(keep) > self.limit:
            self.pieces = self.pieces.filter(pa.array(keep))
            self.ids = self.ids[np.repeat(keep, self.sizes)]
            self.sizes = self.sizes[keep]
            self.before = np.ones(len(self.pieces), bool)

    def numbers(self, pieces: pa.Array, path: str) -> np.ndarray:
        """Where pieces are in the memo; new ones are encoded."""
        known = len(self)
        coded = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()  # numbers the memo's pieces first, as they are
        numbers = coded.indices.to_numpy()[known:]
        if len(coded.dictionary) > known:
            ids, sizes = _encoded(coded.dictionary[known:], path)
            self.pieces = coded.dictionary
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.before = np.append(self.before, np.zeros(len(sizes), bool))
        self.before[numbers] = False
        return numbers


@cache
def _memo(path: str) -> _Lately:
    return _Lately(MEMO_PIECES)


#: Classes of bytes: white space, letters, digits, marks, the rest of ASCII, bytes beyond ASCII.
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER, _HIGH = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[list(_MARKS.encode())] = _MARK
_CLASS[0x80:] = _HIGH
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The characters that a byte-level model has for bytes that are no visible character of Latin-1.
_AS_CHARACTERS = {byte: 256 + 33 + i for i, byte in enumerate([*range(0x7F, 0xA1), 0xAD])}


def _split(data: np.ndarray, offsets: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces of texts begin, the texts' bytes as the pieces have them, and which piece is the first of each text.

    White space is left out. If `apart`, words of Latin-1 letters, ASCII digits and marks are split into runs of letters
    in lower case, runs of marks, and single digits; other words are whole.
    """
    kind = _CLASS[data]
    begin = np.empty(len(data), bool)
    kept = kind != _SPACE
    begin[0], begin[1:] = True, kept[1:] != kept[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    if apart:
        upper = (data >= 0x41) & (data <= 0x5A)
        lead = np.flatnonzero(data == 0xC3)  # of letters that NFC leaves alone, and two signs
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        upper[lead + 1] = data[lead + 1] < 0x9F
        inner = kind == _DIGIT
        inner[1:] |= kind[1:] != kind[:-1]
        whole = kind >= _OTHER
        if whole.any():
            word = np.cumsum(begin, dtype=np.int32)
            some = np.zeros(word[-1] + 1, bool)
            some[word[whole]] = True
            split = ~some[word]
            inner &= split
            upper &= split
        data = data + (upper * np.uint8(0x20))
        begin |= inner
    begin &= kept
    return np.flatnonzero(begin[kept]), data[kept], np.searchsorted(np.flatnonzero(begin), offsets)


def encode_texts(texts: pa.Array, path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit words, without special tokens at its ends.

    For tokenizers that never join characters across ASCII white space, and drop it: a text's ids are then
    those of its pieces, and each distinct piece is encoded once.
    """
    data, offsets = utf8(texts)
    if not len(data):
        return [b""] * len(texts)
    starts, data, edges = _split(data, offsets, _tokenizer(path)[2] is not None)
    buffers = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]
    memo = _memo(path)
    memo.renew()
    at = memo.numbers(pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), path)
    n = memo.sizes.astype(np.int32)[at]
    ends = np.append(0, np.cumsum(n))
    edges = (4 * ends[edges]).tolist()
    del starts, data
    place = np.repeat((np.cumsum(memo.sizes) - memo.sizes)[at] - ends[:-1], n)
    place += np.arange(ends[-1])
    ids = memo.ids[place].tobytes()
    return [ids[a:b] for a, b in zip(edges, edges[1:])]


def _encoded(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct pieces, and how many each has.

    The tokenizer leaves a run of ASCII letters in lower case, a run of marks or a digit as it is, so its model gets
    those at once, in texts of many; the ids that end a run tell them apart.
    """
    _, bare, ends = _tokenizer(path)
    words = pieces.cast(pa.large_string())
    data, offsets = utf8(words)
    worst = np.maximum.reduceat(_CLASS[data], offsets[:-1])
    plain = (worst < _OTHER) & (ends is not None)
    words = words.filter(pa.array(plain))
    edges = pa.array([*range(0, len(words), 256), len(words)], pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(edges, words), pa.scalar(" ", pa.large_string())).to_pylist()
    coded = bare.encode_batch_fast(texts, add_special_tokens=False)
    ids = np.fromiter(chain.from_iterable(c.ids for c in coded), "<u4")
    last = np.flatnonzero(ends[ids]) if len(ids) else np.zeros(0, np.int64)
    if len(last) != len(words) or len(ids) and last[-1] != len(ids) - 1:
        plain[:], ids, last = False, ids[:0], last[:0]  # not a model of the kind that the pieces suggest
    rest = pieces.filter(pa.array(~plain)).to_pylist()
    known: dict[bytes, bytes] = {}
    _learn_pieces(known, rest, path)
    sizes = np.empty(len(pieces), np.int64)
    sizes[plain] = np.diff(last, prepend=-1)
    sizes[~plain] = [len(known[piece]) // 4 for piece in rest]
    out = np.empty(int(sizes.sum()), "<u4")
    own = np.repeat(plain, sizes)
    out[own] = ids
    out[~own] = np.frombuffer(b"".join(known[piece] for piece in rest), "<u4")
    return out, sizes


def _learn_pieces(memo: dict[bytes, bytes], pieces: list[bytes], path: str) -> None:
    """Encode distinct pieces: those of letters or marks many at a time, told apart by the ids that end a run of them.

    A run of Latin-1 letters in lower case only has its bytes written as characters before it goes to the model.
    """
    tokenizer, bare, ends = _tokenizer(path)
    latin, plain, runs, single = [], [], [], []
    for piece in pieces:
        if ends is not None and _LATIN.fullmatch(piece):
            latin.append(piece)
            continue
        text = piece.decode()
        core = text.strip(_MARKS)
        if ends is not None and (not core or core.isalpha() and core.lower().isalpha()):
            plain.append(piece)
            runs.append(1 + (text[0] in _MARKS) + (text[-1] in _MARKS) if core else 1)
        else:
            single.append(piece)
    chunks = [(latin[i : i + 256], np.arange(1, len(latin[i : i + 256]) + 1)) for i in range(0, len(latin), 256)]
    texts = [b" ".join(some).decode("latin-1").translate(_AS_CHARACTERS) for some, _ in chunks]
    coded = bare.encode_batch_fast(texts, add_special_tokens=False)
    more = [(plain[i : i + 256], np.cumsum(runs[i : i + 256])) for i in range(0, len(plain), 256)]
    coded += tokenizer.encode_batch_fast([b" ".join(some).decode() for some, _ in more], add_special_tokens=False)
    for (some, expected), code in zip(chunks + more, coded):
        ids = np.array(code.ids, "<u4")
        last = np.flatnonzero(ends[ids])
        if len(last) != expected[-1] or last[-1] != len(ids) - 1:
            single += some  # letters that the tokenizer changes into something else
            continue
        stops = (4 * (last[expected - 1] + 1)).tolist()
        data = ids.tobytes()
        memo.update((x, data[a:b]) for x, a, b in zip(some, [0, *stops], stops))
    coded = tokenizer.encode_batch_fast([piece.decode() for piece in single], add_special_tokens=False)
    memo.update((x, np.array(c.ids, "<u4").tobytes()) for x, c in zip(single, coded))


def _together(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes, or more if a single one has more."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode doc_id and text of all documents to files at `path`, each document followed by `end_id`.

    A null text is an empty one. Ids of one document stay together; rows of one id are ordered by text. A
    shard is a range of ids that one task writes.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()
    names = ["shard", "segment", "first", "doc_ids", "lengths", "blocks"]

    def segments(shards: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Scalar], list[int], np.ndarray]]:
        def segment():
            return shard, ids, [len(c) // 4 for c in coded], np.frombuffer(b"".join(coded), "<u4")

        ids, coded, size = [], [], 0
        for part, texts in text_slices(_together(shards, TEXT_BYTES), limit=TEXT_BYTES):
            shard = part.column("shard")[0].as_py()
            for doc_id, code in zip(part.column("doc_id"), encode_texts(texts, tokenizer)):
                ids.append(doc_id)
                coded.append(code + end)
                size += len(coded[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    ids, coded, size = [], [], 0
        if ids:
            yield segment()

    def rows(found: list[tuple], number: int, first: int) -> tuple[pa.RecordBatch, int]:
        streams = [stream for *_, stream in found]
        release_unused()
        cuts = [[s[a : a + BLOCK_IDS] for a in range(0, len(s), BLOCK_IDS)] for s in streams]
        coded = iter(encode_blocks([b for blocks in cuts for b in blocks]))
        firsts = (first + np.cumsum([0, *map(len, streams)])).tolist()
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([shard for shard, *_ in found], pa.int32()),
                pa.array(range(number, number + len(found)), pa.int64()),
                pa.array(firsts[:-1], pa.int64()),
                pa.array([[i.as_py() for i in ids] for _, ids, *_ in found], pa.list_(found[0][1][0].type)),
                pa.array([lengths for _, _, lengths, _ in found], pa.list_(pa.int64())),
                pa.array([[next(coded) for _ in blocks] for blocks in cuts], pa.list_(pa.binary())),
            ],
            names=names,
        )
        return batch, firsts[-1]

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A few rows at a time go to the JVM."""
        return (batch.slice(i, 16) for i in range(0, batch.num_rows, 16))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, first, blocks = [], 0, 0, 0
        for found in segments(batches):
            held.append(found)
            blocks += -(-len(found[3]) // BLOCK_IDS)
            if blocks >= LANES:
                batch, first = rows(held, number, first)
                number, held, blocks = number + len(held), [], 0
                yield from parts(batch)
        if held:
            yield from parts(rows(held, number, first)[0])

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    schema = f"shard int, segment long, first long, doc_ids array<{kind}>, lengths array<long>, blocks array<binary>"
    with shuffles_removed(docs.sparkSession):
        ordered.mapInArrow(write, schema).write.parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """Documents of files that `write_ids` made: doc_id, start (ids before it in all files), ids (32-bit words)."""
    prepare(files.sparkSession)
    kind = dict(files.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    sizes = files.select("shard", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    totals = write_once(sizes.groupBy("shard").agg(F.sum("n").alias("n")))  # a row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memo.cache_clear()  # a worker that reads needs no tokenizer any more
        _tokenizer.cache_clear()
        for whole in batches:
            for at in range(0, whole.num_rows, LANES // 16):
                yield from _read(whole.slice(at, LANES // 16))
        release_unused()

    return files.join(F.broadcast(begins), "shard").select("begin", "first", "doc_ids", "lengths", "blocks").mapInArrow(
        read, f"doc_id {kind}, start long, ids binary"
    )


def _read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents of each segment; its blocks go when it is done."""
    coded = batch.column("blocks").to_pylist()
    sizes = [len(blocks) for blocks in coded]
    decoded = decode_blocks([b for blocks in coded for b in blocks])[::-1]
    del coded
    for row, n_blocks in enumerate(sizes):
        ids = np.concatenate([decoded.pop() for _ in range(n_blocks)]).astype("<u4").tobytes()
        start = batch.column("begin")[row].as_py() + batch.column("first")[row].as_py()
        ends = np.cumsum([0, *batch.column("lengths")[row].as_py()]).tolist()
        starts = pa.array([start + end for end in ends[:-1]], pa.int64())
        found = pa.array([ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, starts, found], names=["doc_id", "start", "ids"])


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the documents' ids to `path` (or a new folder beside the checkpoints) and read them back.

    One row per row of `docs`: doc_id, start, n_tokens and ids_crc32 of all its ids, the end id included.
    """
    spark = prepare(docs.sparkSession)
    if path is None:
        path = scratch_path(spark, ".ids.parquet")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark.read.parquet(path)).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )

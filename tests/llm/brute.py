"""Plain versions of the document operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(docs, width, percent):
    """{doc_id: (n_shingles, component_id)} of a dict of texts."""
    sets = {d: shingles(t, width) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def without_repeats(docs, window):
    """[(doc_id, n_words, n_removed, sha256)] of a list of (doc_id, text)."""
    split = [words(t) for _, t in docs]
    times = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, split):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def token_rows(docs, tokenizer, end_id):
    """[(doc_id, start, n_tokens, ids_crc32)] of (doc_id, text) rows in order."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def alignment(item, passage, match=2, mismatch=-1, gap=-1):
    """Best local alignment score of two word lists."""
    best, above = 0, [0] * (len(passage) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(passage):
            row.append(max(0, above[j] + (match if x == y else mismatch), above[j + 1] + gap, row[j] + gap))
        best, above = max(best, *row), row
    return best


def phrases(sample_pieces, text):
    """Phrases of a cross-parsing of folded text by folded pieces."""
    count = i = 0
    while i < len(text):
        j = i
        while j < len(text) and any(text[i : j + 1] in piece for piece in sample_pieces):
            j += 1
        i = max(j, i + 1)
        count += 1
    return count


def looped(doc_id, text):
    """The words of a document of the periodic run query."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def periodic_runs(w):
    """{(start, length, period)} of a list of words."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def run_row(doc_id, text):
    """The row of a document in the periodic run query, without its id."""
    w = looped(doc_id, text)
    runs = periodic_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, left)]
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)

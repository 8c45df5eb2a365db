"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A window class holds the templates of up to `w` shingles (a power of two). Windows of 2 w shingles begin at
every w-th shingle of a document, so each passage of up to w shingles lies whole in one of them. A window with
LEAST_CONTAINMENT of a template then has a Jaccard similarity to it of LEAST_CONTAINMENT * m / (2 w + m) or
more, with m > w / 2 shingles of the template. From that bound `bands` takes as many one-row bands as make a
collision as probable as CERTAINTY. Minima of longer windows come from those of shorter ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sojourn.llm.common import ALNUM, mix, prepare, span_hashes, text_slices, word_hashes, words_of

WIDTH = 5
LEAST_CONTAINMENT = 0.8
CERTAINTY = 0.999
SMALLEST_CLASS = 1

# Usual notices of licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
}


def bands(least: float = LEAST_CONTAINMENT, certainty: float = CERTAINTY) -> int:
    """One-row bands that collide as surely as `certainty` at the least similarity a match can have."""
    similarity = least / 5  # less than least * m / (2 w + m - least * m) for any m > w / 2
    return math.ceil(math.log(1 - certainty) / math.log(1 - similarity))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of WIDTH words (lower case, punctuation aside), and where each text's begin."""
    words = words_of(pc.utf8_lower(texts), ALNUM)
    hashes = word_hashes(words)
    count = np.maximum(np.diff(words.first) - WIDTH + 1, 0)
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    owner = np.repeat(np.arange(len(count)), count)
    starts = words.first[owner] + np.arange(first[-1]) - first[owner]
    return span_hashes(hashes, starts, starts + WIDTH), first


def _halved(first: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins of runs of `by` values that don't cross a text's end, and the runs' places by text."""
    count = -(-np.diff(first) // by)
    runs = np.zeros(len(first), np.int64)
    np.cumsum(count, out=runs[1:])
    owner = np.repeat(np.arange(len(count)), count)
    return first[owner] + by * (np.arange(runs[-1]) - runs[owner]), runs


class Templates:
    """The templates' shingles, and by window class and band the minima that retrieve them."""

    def __init__(self, texts: Mapping[str, str]):
        self.names = sorted(texts)
        hashes, first = _shingles(pa.array([texts[n] for n in self.names], pa.string()))
        self.shingles = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
        if short := [n for n, s in zip(self.names, self.shingles) if not len(s)]:
            raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
        self.factors = mix(np.arange(1, bands() + 1, dtype=np.uint64)) | np.uint64(1)
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        for i, shingles in enumerate(self.shingles):
            size = max(SMALLEST_CLASS, 1 << (len(shingles) - 1).bit_length())
            tables = self.classes.setdefault(size, [{} for _ in self.factors])
            for table, factor in zip(tables, self.factors):
                table.setdefault(int((shingles * factor).min()), []).append(i)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, begin, end) of the windows that share a minimum with a template."""
        found: set[tuple[int, int, int]] = set()
        if not len(hashes) or not self.classes:
            return found
        grids, size, runs = {}, SMALLEST_CLASS, first
        begins, by = None, SMALLEST_CLASS
        while size <= max(self.classes):
            begins, runs = _halved(runs, by)
            grids[size] = (begins, runs)
            size, by = 2 * size, 2
        stops = {size: np.repeat(runs[1:], np.diff(runs)) for size, (_, runs) in grids.items()}
        for band, factor in enumerate(self.factors):
            minima = hashes * factor
            for size, (begins, runs) in grids.items():
                minima = np.minimum.reduceat(minima, begins)
                if size not in self.classes:
                    continue
                table = self.classes[size][band]
                window = minima.copy()
                inner = np.flatnonzero(np.arange(1, len(minima) + 1) < stops[size])
                window[inner] = np.minimum(minima[inner], minima[inner + 1])
                known = np.fromiter(table, np.uint64, len(table))
                for run in np.flatnonzero(np.isin(window, known)).tolist():
                    text = int(np.searchsorted(runs, run, side="right")) - 1
                    begin = int(first[text]) + size * (run - int(runs[text]))
                    end = min(begin + 2 * size, int(first[text + 1]))
                    found.update((t, begin, end) for t in table[int(window[run])])
        return found


def license_notices(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_CONTAINMENT
) -> DataFrame:
    """One row per document and template that it holds: doc_id, template, containment, first_word, last_word.

    Containment is the share of the template's distinct runs of WIDTH words that lie in one window. Of several
    windows the best counts, of equals the first; its words are numbered from 0. Null, empty and short texts
    hold nothing. `templates` is a list in memory, sent to the workers.
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(Templates(templates))
    kind = dict(docs.dtypes)["doc_id"]
    named = ["doc_id", "template", "containment", "first_word", "last_word"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Templates = model.value
        for part, texts in text_slices(batches):
            hashes, first = _shingles(texts)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for t, begin, end in sorted(known.candidates(hashes, first)):
                held = np.flatnonzero(np.isin(hashes[begin:end], known.shingles[t]))
                share = len(np.unique(hashes[begin:end][held])) / len(known.shingles[t])
                text = int(np.searchsorted(first, begin, side="right")) - 1
                if share >= least and share > best.get((text, t), (0.0, 0, 0))[0]:
                    at = begin - int(first[text])
                    best[text, t] = (share, at + int(held[0]), at + int(held[-1]) + WIDTH - 1)
            columns = [
                part.column("doc_id").take(pa.array([k[0] for k in best], pa.int64())),
                pa.array([known.names[k[1]] for k in best], pa.string()),
                pa.array([v[0] for v in best.values()], pa.float64()),
                pa.array([v[1] for v in best.values()], pa.int64()),
                pa.array([v[2] for v in best.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=named)

    schema = f"doc_id {kind}, template string, containment double, first_word long, last_word long"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)

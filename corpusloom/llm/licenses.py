"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words are compared lower-cased and without punctuation at their ends. Of a template of n words a match may miss n - needed,
where needed is 0.8 n rounded up. A text that leaves out, replaces or interrupts the template at no more places than that
keeps a run of needed / (n - needed + 1) template words at least (pigeonhole), and the template's k-grams are winnowed so that
each run of that length holds a selected one; short templates so keep all their pairs. The inverted index of these
k-grams finds all runs in the text, whose diagonals are the middle of the band. An interruption may put in up to
``gap(n)`` words (all of a match together): the band is as wide as that and the missing words, so every such match is found. With more
interruptions a match is found if some selected k-gram survives; put-in words beyond the band end it.
Templates are a parameter of bounded size; their index travels with the tasks, and documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_words, slices, text_array

LEAST_WORDS = 3  # of a template
MIN_COVERAGE = 0.8
GRAM = 3  # words of a k-gram, fewer where the coverage leaves shorter runs
LEAST_GAP = 8
MOST_WORDS = 1_000_000  # of all templates together
SEED = 42
EDGES = ".,;:!?()[]{}<>\"'*#$%&|_-+=~^`"
_word = re.compile(r"[^\x20\x09-\x0D]+")

# Notices by which licenses are told, in the wording of the licenses themselves.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at"
    ),
    "BSD clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction'
    ),
    "reserved": "All rights reserved.",
}


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' normalised words in a row, and where each text's words start (one more entry)."""
    words, starts = ascii_words(texts)
    coded = pc.utf8_trim(words, characters=EDGES).dictionary_encode()
    hashes = [xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    return np.array(hashes, dtype=np.uint64)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64), starts


def gap(n: int) -> int:
    """Words that a match of a template of n words may hold between its own, in all."""
    return max(LEAST_GAP, n // 2)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row."""
    n = max(0, len(words) - k + 1)
    hashes = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        hashes = (hashes ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return hashes


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hash of every window of w, the rightmost of equals."""
    if len(hashes) <= w:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(windows)) + w - 1 - windows[:, ::-1].argmin(axis=1))


class Index:
    """For each length of k-grams: the selected hashes of all templates, sorted, with their template and place."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = list(templates)
        words, starts = word_hashes(pa.array(templates.values(), pa.large_string()))
        if len(words) > MOST_WORDS:
            raise ValueError(f"templates hold {len(words)} words; the index is meant for {MOST_WORDS}")
        short = [name for name, n in zip(self.names, np.diff(starts), strict=True) if n < LEAST_WORDS]
        if short:
            raise ValueError(f"templates of fewer than {LEAST_WORDS} words: {short}")
        self.words = [words[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.needed = [math.ceil(MIN_COVERAGE * len(w)) for w in self.words]
        self.band = [len(w) - needed + gap(len(w)) for w, needed in zip(self.words, self.needed, strict=True)]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for t, (own, needed) in enumerate(zip(self.words, self.needed, strict=True)):
            run = -(-needed // (len(own) - needed + 1))  # words in a row that the edits leave somewhere
            k = min(GRAM, run)
            hashes = gram_hashes(own, k)
            at = winnow(hashes, run - k + 1)
            found.setdefault(k, []).append((hashes[at], np.full(len(at), t), at))
        self.grams = {}
        for k, parts in found.items():
            hashes, template, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.grams[k] = hashes[order], template[order], place[order]

    def seeds(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct rows (text, template, diagonal: place in the text less place in the template) of all shared k-grams."""
        found = [np.empty((0, 3), np.int64)]
        for k, (hashes, template, place) in self.grams.items():
            grams = gram_hashes(words, k)
            low, high = (hashes.searchsorted(grams, side=side) for side in ("left", "right"))
            hit = np.flatnonzero(high > low)
            text = starts.searchsorted(hit, side="right") - 1
            inside = hit + k <= starts[text + 1]  # not one that reaches into the next text
            hit, text = hit[inside], text[inside]
            counts = (high - low)[hit]
            entry = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append(np.column_stack((np.repeat(text, counts), template[entry], np.repeat(hit - starts[text], counts) - place[entry])))
        return np.unique(np.concatenate(found), axis=0)


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words in order in the text on diagonals low..high (text less template place), and their shortest span.

    Row by row over the template, a whole band at once. A cell holds matched words and, in its low half, where they
    start; equal matches prefer the later start.
    """
    one, width = 1 << 32, high - low + 1
    before, after = max(0, -low), max(0, high + len(template) - len(text))
    padded = np.concatenate((np.zeros(before, text.dtype), text, np.zeros(after, text.dtype)))
    cells, place = np.zeros(width, np.int64), np.arange(low, high + 1)
    best, best_key = (0, 0, 0), 0
    for i, wanted in enumerate(template):
        hit = np.flatnonzero(padded[before + low + i : before + low + i + width] == wanted)
        new = np.maximum(cells, np.append(cells[1:], 0))  # the template's word is left out
        if len(hit):
            at = place[hit] + i
            grown = np.where(cells[hit] > 0, cells[hit], at) + one
            key = (grown >> 32) * one - (at + 1 - (grown & (one - 1)))
            top = int(key.argmax())
            if key[top] > best_key:
                best_key, best = int(key[top]), (int(grown[top] >> 32), int(grown[top] & (one - 1)), int(at[top]) + 1)
            new[hit] = np.maximum(new[hit], grown)
        cells = np.maximum.accumulate(new)  # words of the text are left out
    return best


def occurrences(words: np.ndarray, template: np.ndarray, needed: int, band: int, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches (first word, end, matched words) of a template in a text, none overlapping; ``diagonals`` sorted.

    Diagonals within a band of the first are aligned together; the best match is taken out of the text, then the next.
    """
    words, found, at = words.copy(), [], 0
    while at < len(diagonals):
        low, end = int(diagonals[at]), int(diagonals.searchsorted(diagonals[at] + band, side="right"))
        high, at = int(diagonals[end - 1]), end
        start = max(0, low - band)
        part = words[start : high + len(template) + band]  # a view: what is taken out stays out
        while np.isin(part, template).sum() >= needed:
            n, first, last = align(part, template, low - band - start, high + band - start)
            if n < needed:
                break
            found.append((start + first, start + last, n))
            part[first:last] = 0
    return sorted(found)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per match: ``doc_id``, ``license``, ``coverage`` (share of the template's words), ``matched_words``, ``span_start``, ``span_end``.

    Spans are code points of the text. Matches cover at least 0.8 of their template; several in one text are several
    rows, and rows that repeat a document repeat its matches. Null and empty texts have none, nor has an empty table; other columns
    are not looked at, and a null id is kept.
    """
    index = Index(templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = text_array(part.column("text"))
            words, starts = word_hashes(texts)
            seeds = index.seeds(words, starts)
            ids = part.column("doc_id")
            rows = []
            cuts = np.flatnonzero((seeds[1:, :2] != seeds[:-1, :2]).any(axis=1)) + 1
            for own in np.split(seeds, cuts) if len(seeds) else []:
                i, t = int(own[0, 0]), int(own[0, 1])
                found = occurrences(words[starts[i] : starts[i + 1]], index.words[t], index.needed[t], index.band[t], own[:, 2])
                spans = [m.span() for m in _word.finditer(texts[i].as_py())] if found else []
                for start, end, n in found:
                    rows.append((ids[i].as_py(), index.names[t], n / len(index.words[t]), n, spans[start][0], spans[end - 1][1]))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "license", "coverage", "matched_words", "span_start", "span_end"]
    schema = "doc_id long, license string, coverage double, matched_words long, span_start long, span_end long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)

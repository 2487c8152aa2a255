"""License notices in texts (operator 4).

Templates are retrieved by MinHash: for every hash function, the least value over
the shingles of a window is compared with the template's. Windows overlap by
half and are two to four times as long as the templates that they may retrieve,
so that a notice lies whole in one window, whose similarity with the template is
then at least a quarter; MINHASHES bands of one value miss such a window once in
ten thousand times. In what the windows of a template cover, a span is slid that
is a quarter longer than the template, and the share of the template's shingles
that really stand in it decides. Of overlapping spans of one license the fullest
stays, of equally full ones the shortest.
"""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import arrow_task, columns_of

# Wording of well-known license notices.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "mit": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
}

#: Words of a shingle; hash functions, each a band of its own; least share of a template's shingles.
SHINGLE, MINHASHES, CONTAINED = 3, 32, 0.8
#: Shingles of a text that are looked at together, at least.
BLOCK = 1 << 15
WORD = re.compile(r"[^\W_]+")
KEPT = 500_000

_MIX = np.random.default_rng(1_404)
MULTIPLIERS = _MIX.integers(1 << 62, 1 << 63, MINHASHES, dtype=np.uint64) | np.uint64(1)
MASKS = _MIX.integers(1, 1 << 63, MINHASHES, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Hashes of all runs of SHINGLE lower-case words, in order."""
    if len(_HASHES) > KEPT:
        _HASHES.clear()
    words = WORD.findall(text.lower())
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return hashes[:0]
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total = (total ^ hashes[i:n + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


@dataclass(frozen=True)
class Template:
    """A notice: its license, its length in shingles, its distinct shingles in order, and the least value of every hash function."""

    license: str
    length: int
    shingles: np.ndarray
    minima: np.ndarray


def minima(values: np.ndarray) -> np.ndarray:
    return ((values[None, :] ^ MASKS[:, None]) * MULTIPLIERS[:, None]).min(axis=1)


def templates(notices: dict[str, list[str]]) -> list[Template]:
    """Templates of notices of any length; those under SHINGLE words have no shingle and are refused."""
    out = []
    for name, texts in notices.items():
        for text in texts:
            stream = shingles(text)
            if not len(stream):
                raise ValueError(f"a notice of {name} has under {SHINGLE} words")
            found = np.unique(stream)
            out.append(Template(name, len(stream), found, minima(found)))
    return out


class Scanner:
    """Finds the templates in texts."""

    def __init__(self, notices: dict[str, list[str]]):
        #: templates by the least power of two that holds them; windows are twice as long
        self.classes: dict[int, list[Template]] = {}
        for template in templates(notices):
            self.classes.setdefault(1 << (template.length - 1).bit_length(), []).append(template)
        self.longest = max(self.classes, default=1)

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, last word, share of the template's shingles), by place."""
        stream = shingles(text or "")
        found: set[tuple[str, int, int, float]] = set()
        size = max(BLOCK, self.longest)
        windows: dict[int, list[int]] = {}
        known: dict[int, tuple[int, Template]] = {}
        for start in range(0, len(stream), size):
            for step, template, at in self.retrieved(stream, start, size):
                windows.setdefault(id(template), []).extend(at)
                known[id(template)] = (step, template)
        for key, at in windows.items():
            step, template = known[key]
            places = np.unique(np.array(at))
            for run in np.split(places, np.flatnonzero(np.diff(places) > 2 * step) + 1):  # windows that touch are searched together
                first = int(run[0])
                part = stream[first:int(run[-1]) + 2 * step + template.length // 4]
                found.update((template.license, first + a, first + b + SHINGLE - 1, share) for a, b, share in self.spans(part, template))
        kept: dict[str, list[tuple[str, int, int, float]]] = {}
        for match in sorted(found, key=lambda m: (-m[3], m[2] - m[1], m[1], m[0])):
            own = kept.setdefault(match[0], [])
            i = bisect(own, match[1], key=lambda m: m[1])
            if (i == 0 or own[i - 1][2] < match[1]) and (i == len(own) or match[2] < own[i][1]):
                own.insert(i, match)
        return sorted((m for own in kept.values() for m in own), key=lambda m: (m[1], m[0]))

    def retrieved(self, stream: np.ndarray, start: int, size: int) -> list[tuple[int, Template, list[int]]]:
        """Step, template and beginnings of its windows in the block of the stream at `start`; the last windows reach beyond it."""
        out = []
        part = stream[start:start + size + self.longest]
        values = np.full((MINHASHES, -(-len(part) // self.longest) * self.longest), np.iinfo(np.uint64).max, np.uint64)
        np.multiply(part[None, :] ^ MASKS[:, None], MULTIPLIERS[:, None], out=values[:, :len(part)])
        cells, width = values, 1
        for step, own in sorted(self.classes.items()):
            while width < step:  # cells of twice the width
                cells, width = np.minimum(cells[:, ::2], cells[:, 1::2]), 2 * width
            windows = cells if cells.shape[1] == 1 else np.minimum(cells[:, :-1], cells[:, 1:])
            for template in own:
                hits = np.flatnonzero((windows == template.minima[:, None]).any(axis=0))
                if len(hits):
                    out.append((step, template, (start + hits * step).tolist()))
        return out

    @staticmethod
    def spans(part: np.ndarray, template: Template) -> list[tuple[int, int, float]]:
        """Spans (first, last, share) that hold enough of the template, one for each shingle of it that can begin one.

        A span ends where the last shingle comes that it did not hold before.
        """
        here = np.flatnonzero(np.isin(part, template.shingles))
        least = CONTAINED * len(template.shingles)
        if len(here) < least:
            return []
        # place in `here` of the same shingle's last occurrence before
        values = part[here]
        order = np.argsort(values, kind="stable")
        before = np.full(len(here), -1)
        same = values[order[1:]] == values[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        ends = np.searchsorted(here, here + template.length + template.length // 4)
        out = []
        for i in np.flatnonzero(ends - np.arange(len(here)) >= least):
            fresh = np.flatnonzero(before[i:ends[i]] < i)
            if len(fresh) >= least:
                out.append((int(here[i]), int(here[i + fresh[-1]]), len(fresh) / len(template.shingles)))
        return out


_SCANNERS: dict[str, Scanner] = {}


def scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Notices in every whole text: id, `license`, `first_word`, `last_word` (from 0), `contained` (share of the template).

    A null, empty or short text has none. Repeated rows give repeated notices.
    Matches of one license that overlap count once, the fullest of them and then
    the shortest; copies side by side are found one by one. A notice may be of any
    length from three words on.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    name = repr(sorted(notices.items()))

    def work(batch: pa.RecordBatch) -> dict:
        scanner = _SCANNERS.setdefault(name, None) or Scanner(notices)
        _SCANNERS[name] = scanner
        rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in scanner.find(text)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.float64()]
        return dict(zip((id_col, "license", "first_word", "last_word", "contained"), [pa.array(c, t) for c, t in zip(columns, types, strict=True)], strict=True))

    return arrow_task(columns_of(docs, id_col, text_col), f"`{id_col}` {kind}, license string, first_word long, last_word long, contained double", work)

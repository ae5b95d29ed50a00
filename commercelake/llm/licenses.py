"""License scan: winnowed fingerprints of templates, then banded alignment.

Templates and texts become words, A-Z folded, without punctuation at their ends. Hashes of GRAM
words in a row are winnowed: of every WINDOW neighbours the least is a fingerprint. The
templates' fingerprints form a small inverted index. A hit proposes a template at a place; hits of
nearly the same offset are one candidate. Each candidate is aligned in full within a band around
the offset, and reported with the words matched, their share of the template, and its span.

Templates are whole license texts and notices (licenses.txt) and one-line notices. A template of
LONG words or more is aligned where a share of its fingerprints lies at nearly one offset, within a
band that grows with it. In a shorter one, version and variant words must match exactly.

Null, empty and short texts give no rows, and so do empty tables; a repeated row is scanned again.
Spans are code points, end exclusive. Of matches that overlap, the one with the most words matched
less words missed stays, then the longer template, then the first name. Other columns are ignored.
"""

from __future__ import annotations

import pkgutil
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercelake.llm.words import chunks, text_bytes, windows, word_hashes, word_spans

GRAM = 3
WINDOW = 2
BAND = 6
COVERAGE = 0.8
#: Words from which a template counts as long.
LONG = 60
#: Share of a long template's fingerprints that must lie at nearly one offset.
LEAST_HITS = 0.1
#: Words of a template to a place of its band on either side, if that is wider than BAND.
WORDS_A_PLACE = 25
#: Templates of fewer words must match in their version and variant words.
SHORT = 20


def _whole_texts() -> dict[str, str]:
    parts = pkgutil.get_data(__package__, "licenses.txt").decode().split("%%% ")[1:]
    return dict(p.split("\n", 1) for p in parts)


# Wording of common licenses, and of one-line notes and grants.
TEMPLATES = _whole_texts() | {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-note": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-note": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-note": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Words that tell licenses apart; so does any word with a digit.
VARIANTS = (
    "mit isc bsd apache mozilla mpl gnu gpl lgpl agpl eclipse artistic zlib boost lesser library affero documentation only later "
    "cc cc0 by by-nc by-sa by-nd by-nc-sa by-nc-nd nc sa nd noncommercial sharealike noderivatives"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?()[]{}<>\"'`*#|/-"]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words without punctuation at their ends, and words before each row."""
    starts, ends, at = word_spans(data, offsets)
    for _ in range(3):
        ends = ends - ((ends > starts) & _EDGE[data[np.maximum(ends - 1, 0)]] if len(data) else 0)
        starts = starts + ((ends > starts) & _EDGE[data[np.minimum(starts, len(data) - 1)]] if len(data) else 0)
    return starts, ends, word_hashes(data, starts, ends, fold=True), at


def _telling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which words are a version or a variant."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    raw = " ".join(VARIANTS).encode()
    names = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[2]
    return (digits[ends] > digits[starts]) | np.isin(hashes, names)


def winnow(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a sequence of words and their places."""
    grams = windows(hashes, GRAM)
    if len(grams) < WINDOW:
        return grams, np.arange(len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return grams[at], at


def _template_index(templates: dict[str, str]):
    index, bodies = defaultdict(list), []
    for t, (name, text) in enumerate(templates.items()):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, hashes, _ = _words(raw, np.array([0, len(raw)]))
        prints = [x.tolist() for x in winnow(hashes)]
        telling = hashes[_telling(raw, starts, ends, hashes)].tolist() if len(hashes) < SHORT else None
        bodies.append((name, hashes.tolist() if len(hashes) < LONG else hashes, telling, len(prints[0])))
        for h, i in zip(*prints, strict=True):
            index[h].append((t, i))
    return index, bodies


def align(template: list[int], text: list[int], offset: int, band: int = BAND) -> tuple[int, int, int]:
    """Most words of the template matched in order near the offset, and first and last place.

    One row per word of the template, only places within the band of its diagonal; of equal
    alignments the shortest span counts.
    """
    # Best (matched, -span, first, last) with the last place at most p, by place of the band.
    width = 2 * band + 1
    row: list[tuple[int, int, int, int]] = [(0, 0, -1, -1)] * width
    for i, w in enumerate(template):
        new: list[tuple[int, int, int, int]] = []
        for d in range(width):
            p = i + offset + d - band
            best = row[d + 1] if d + 1 < width else (0, 0, -1, -1)
            if new and new[-1] > best:
                best = new[-1]
            if 0 <= p < len(text) and text[p] == w:
                m, _, first, _ = row[d]
                first = p if first < 0 else first
                hit = (m + 1, first - p, first, p)
                best = max(best, hit)
            new.append(best)
        row = new
    m, _, first, last = max(row)
    return m, first, last


def align_long(template: np.ndarray, text: np.ndarray, offset: int, band: int) -> tuple[int, int, int]:
    """As align, for long templates: a row of the band at once.

    A cell holds the words matched, then the first place, then the last one downwards, both from the
    band's start in 20 bits; of equal matches the later first place and then the earlier last one count.
    """
    width, start, low = 2 * band + 1, offset - band, (1 << 20) - 1
    row = np.zeros(width + 1, np.int64)
    for i, w in enumerate(template):
        lo, hi = max(0, -(start + i)), min(width, len(text) - start - i)
        new = np.zeros(width + 1, np.int64)
        new[:width] = row[1:]
        if lo < hi:
            at = np.flatnonzero(text[start + i + lo : start + i + hi] == w) + lo
            before, place = row[at], at + i
            first = np.where(before > 0, before >> 20, place)
            new[at] = np.maximum(new[at], (((before >> 40) + 1) << 40) | ((first & low) << 20) | (low - place))
        new[:width] = np.maximum.accumulate(new[:width])
        row = new
    best = int(row.max())
    return (best >> 40, start + (best >> 20 & low), start + low - (best & low)) if best else (0, -1, -1)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, start, end, matched, template_words and coverage of every match."""
    index, bodies = _template_index(templates)
    known = np.array(sorted(index), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = defaultdict(list)
            rows = []
            data, offsets = text_bytes(b.column(1))
            for a, z in chunks(offsets):
                raw, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                starts, ends, hashes, at = _words(raw, own)
                grams = windows(hashes, GRAM)
                near = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                texts = np.unique(np.searchsorted(at, np.flatnonzero(known[near] == grams), side="right") - 1)
                telling = _telling(raw, starts, ends, hashes)
                heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                for i in texts.tolist():
                    first = at[i]
                    for name, m, n, s, e in _matches(hashes[first : at[i + 1]], telling[first : at[i + 1]], index, bodies, coverage):
                        rows.append(a + i)
                        base = heads[own[i]]
                        for k, v in zip(("license", "start", "end", "matched", "template_words"), (name, int(heads[starts[first + s]] - base), int(heads[ends[first + e]] - base), m, n), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(out["license"], pa.string()), *[pa.array(out[k], pa.int64()) for k in ("start", "end", "matched", "template_words")]],
                names=["doc_id", "license", "start", "end", "matched", "template_words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, license string, start bigint, end bigint, matched bigint, template_words bigint")
    return found.withColumn("coverage", F.col("matched") / F.col("template_words"))


def _dense(hits: set[tuple[int, int]], band: int, least: float) -> Iterator[int]:
    """Offsets around which at least so many different fingerprints of a template lie, the densest first."""
    pairs = np.array(sorted(hits))
    while len(pairs) >= least:
        ends = np.searchsorted(pairs[:, 0], pairs[:, 0] + 2 * band, side="right")
        at = int(np.argmax(ends - np.arange(len(pairs))))
        inside = pairs[at : ends[at]]
        if len(inside) < least:
            return
        if len(np.unique(inside[:, 1])) >= least:
            yield int(np.median(inside[:, 0]))
        pairs = np.concatenate([pairs[:at], pairs[ends[at] :]])


def _matches(hashes: np.ndarray, telling: np.ndarray, index: dict, bodies: list, coverage: float) -> list[tuple[str, int, int, int, int]]:
    proposed = defaultdict(set)
    for h, p in zip(*(x.tolist() for x in winnow(hashes)), strict=True):
        for t, i in index.get(h, ()):
            proposed[t].add((p - i, i))
    text, found = hashes.tolist() if proposed else [], []
    for t, hits in proposed.items():
        name, body, exact, prints = bodies[t]
        if len(body) >= LONG:
            band = max(BAND, len(body) // WORDS_A_PLACE)
            for offset in _dense(hits, band, max(3.0, LEAST_HITS * prints)):
                m, s, e = align_long(body, hashes, offset, band)
                if m >= coverage * len(body):
                    found.append((name, m, len(body), s, e))
            continue
        last = None
        for offset in sorted({o for o, _ in hits}):
            if last is not None and offset - last <= BAND // 2:
                continue
            last = offset
            m, s, e = align(body, text, offset)
            if m >= coverage * len(body) and (exact is None or hashes[s : e + 1][telling[s : e + 1]].tolist() == exact):
                found.append((name, m, len(body), s, e))
    found.sort(key=lambda f: (f[2] - 2 * f[1], -f[2], f[0], f[3]))
    kept: list[tuple[str, int, int, int, int]] = []
    for f in found:
        if all(f[4] < k[3] or f[3] > k[4] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])

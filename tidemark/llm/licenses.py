"""License scans: MinHash bands over overlapping text windows, exact shingle containment after.

A template of T five-word shingles is looked for in windows of three blocks of B shingles
that move on by a block, B being the least power of two with T <= 2 B: an occurrence then
lies whole in some window.  Windows start anew at each text.  With at least 0.8 of its shingles there,
the Jaccard similarity of template and window is 0.25 at least, so with BANDS bands of one MinHash
value each the chance that no band agrees is at most 0.75 ** 32 = 0.0001 (0.000003 for a
whole copy).  Retrieved templates are verified by the words themselves.

Templates are whole licence texts (the files in ``license_texts``) and the notices by which works
refer to them.  A template that lies in a larger one found at the same place gives way to it
if at least half of what the larger one has beside it is there too.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .batches import ALNUM, chunks, lower_ascii, map_arrow, mix, narrow, ragged, runs, texts, word_hashes, words

BANDS = 32
SHINGLE = 5

# Usual notices, as the licences' texts and their users write them: licence / kind.
NOTICES = {
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT/notice": "Released under the MIT License.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def templates() -> dict[str, str]:
    """The notices, and the whole texts as "licence/text"."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return NOTICES | {f"{f.stem}/text": f.read_text(encoding="utf-8") for f in files}


_factors = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_masks = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


class Templates:
    """Shingles and band tables of the templates, by block size."""

    def __init__(self, named: dict[str, str]):
        self.names = sorted(named)
        self.shingles: list[set[bytes]] = []
        self.by: dict[int, list[list[tuple[int, int]]]] = {}
        for t, name in enumerate(self.names):
            data, offsets = texts(pa.array([named[name]]))
            data = lower_ascii(data)
            starts, ends, _ = words(data, offsets, ALNUM)
            if len(starts) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            parts = [data[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]
            self.shingles.append({b" ".join(parts[i : i + SHINGLE]) for i in range(len(parts) - SHINGLE + 1)})
            h = np.unique(runs(word_hashes(data, starts, ends), SHINGLE))
            block = 1
            while 2 * block < len(h):
                block *= 2
            for k, v in enumerate(((h[None] ^ _masks[:, None]) * _factors[:, None]).min(axis=1).tolist()):
                self.by.setdefault(block, [[] for _ in range(BANDS)])[k].append((v, t))
        self.maybe = {}
        for block, bands in self.by.items():
            self.maybe[block] = np.zeros((BANDS, 1 << 16), bool)
            for k, band in enumerate(bands):
                self.maybe[block][k, [v >> 48 for v, _ in band]] = True

    def candidates(self, h: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, first shingle in it, block, template) of windows that share a band with a template.

        ``h``: the shingles of all texts, ``sizes`` of them in each.
        """
        found: set[tuple[int, int, int, int]] = set()
        levels, n, block = [], sizes, 1  # of blocks: (where pairs start, texts, place in the text)
        while n.any() and block <= max(self.by):
            at = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            levels.append((block, ragged(np.zeros(len(n), np.int64), n), row))
            half = (n + 1) // 2
            levels[-1] += (np.repeat(at, half) + 2 * ragged(np.zeros(len(n), np.int64), half),)
            n, block = half, block * 2
        for k in range(BANDS):
            mins = (h ^ _masks[k]) * _factors[k]
            for block, place, row, pairs in levels:
                if block in self.by:
                    window = mins.copy()
                    for step in (1, 2):
                        same = row[step:] == row[:-step]
                        window[:-step][same] = np.minimum(window[:-step], mins[step:])[same]
                    for i in np.flatnonzero(self.maybe[block][k][(window >> np.uint64(48)).astype(np.int64)]).tolist():
                        v = int(window[i])
                        found |= {(int(row[i]), int(place[i]) * block, block, t) for x, t in self.by[block][k] if x == v}
                mins = np.minimum.reduceat(mins, pairs)
        return found

    def find(self, data: np.ndarray, offsets: np.ndarray, least: float) -> list[dict[int, tuple[float, int]]]:
        """For each text {template: (containment, first word of the first such window)}; ``data`` in lower case."""
        starts, ends, first = words(data, offsets, ALNUM)
        n = len(offsets) - 1
        best: list[dict[int, tuple[float, int, int, set[bytes]]]] = [{} for _ in range(n)]
        sizes = np.maximum(np.diff(first) - SHINGLE + 1, 0)
        h = runs(word_hashes(data, starts, ends), SHINGLE)[ragged(first[:-1], sizes)]
        for row, i, block, t in sorted(self.candidates(h, sizes)):
            a, z = int(first[row]) + i, min(int(first[row]) + i + 3 * block + SHINGLE - 1, int(first[row + 1]))
            parts = [data[x:y].tobytes() for x, y in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)]
            own = {b" ".join(parts[j : j + SHINGLE]) for j in range(len(parts) - SHINGLE + 1)}
            share = len(own & self.shingles[t]) / len(self.shingles[t])
            if share >= least and share > best[row].get(t, (0.0, 0, 0, own))[0]:
                best[row][t] = share, i, i + len(parts), own
        return [{t: (share, i) for t, (share, i, _, _) in sorted(found.items()) if not self._gives_way(t, found, least)} for found in best]

    def _gives_way(self, t: int, found: dict[int, tuple[float, int, int, set[bytes]]], least: float) -> bool:
        """Whether a template at the same place that is much the same is the better name."""
        mine = self.shingles[t]
        _, i, j, _ = found[t]
        for other, (_, a, z, own) in found.items():
            theirs = self.shingles[other]
            if other == t or a >= j or i >= z or len(mine & theirs) < least * min(len(mine), len(theirs)):
                continue
            small, large = sorted((t, other), key=lambda x: (len(self.shingles[x]), x))
            beside = self.shingles[large] - self.shingles[small]
            text = own if large == other else found[t][3]
            if (large if 2 * len(beside & text) >= len(beside) else small) != t:
                return True
        return False


def scan(df: DataFrame, named: dict[str, str] | None = None, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_licenses, licenses, matches) of every row.

    ``licenses``: licences found (the part before "/" of a template's name), sorted, joined by commas (""
    if none); ``matches``: array of (template, containment, first_word): the best window of each,
    of equals the first.  Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.
    Null texts, and texts of fewer than five words, have no matches; repeated rows stay repeated.
    """
    rows = narrow(df, doc_id=doc_id, text=text)
    sent = df.sparkSession.sparkContext.broadcast(Templates(templates() if named is None else named))  # some texts that ship with the code
    match = T.StructType([T.StructField("template", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType())])
    fields = T.StructType([rows.schema["doc_id"], T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("matches", T.ArrayType(match))])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        table = sent.value
        data, offsets = texts(b.column(1))
        found = []
        for i, j in chunks(offsets):
            found += table.find(lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], least)
        lists = [[{"template": table.names[t], "containment": c, "first_word": w} for t, (c, w) in f.items()] for f in found]
        names = [sorted({m["template"].partition("/")[0] for m in x}) for x in lists]
        kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x) for x in names], pa.string()), pa.array(lists, kind)], names=fields.names)

    return map_arrow(rows, fields, batch)

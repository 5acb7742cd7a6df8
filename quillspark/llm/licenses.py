"""License scans by MinHash over text windows (operator 3).

Templates and overlapping windows of every text are sets of word shingles.
Windows come in several lengths, each at least as long as the templates it is
compared with, with a stride that leaves every template-long passage whole in
some window.  MinHash bands of the windows, one hash table for each band,
retrieve templates: within a window that holds the template, the share of
agreeing coordinates is that of the template's shingles in the window, and
``bands_for`` adds bands until the chance to miss a match at the threshold is
below ``MISS``.  Retrieved pairs are then confirmed by exact containment: the
share of the template's distinct shingles found in the window.

Templates, a table or the wordings shipped here, go to the executors with their
band tables, at most ``MAX_TEMPLATES`` and ``MAX_BYTES`` at once.  More of them
take several passes over the documents; what they find is then settled for each
distinct text.  Documents are never shuffled.

Edge cases: null and empty texts match nothing; templates with fewer words than
a shingle are one shingle of all their words; matches of one template that
overlap give one row, the best (containment, then first); A-Z case, punctuation,
white space and the marks that comment lines out (``//``, ``*``, ``#``, ``--``,
``%``, ``;``, ``REM``, ``dnl``) are ignored, and words are counted without them;
null and empty templates match nothing; repeated rows give equal rows; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from importlib import resources

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, in_parts, map_batches, mix, ngrams, slices, table, text_bytes

SHINGLE = 5
PERCENT = 80
MISS = 1e-6
MAX_TEMPLATES = 2_000
MAX_BYTES = 16 << 20
_IGNORED = b".,;:!?\"'()[]{}*_`<>/#%|=~^\\"
_EDGE = bytes.maketrans(_IGNORED, b" " * len(_IGNORED))
#: Dashes, and words, that comment a line out.
_LEADER = re.compile(rb"--+|^[ \t]*(?:-|(?i:rem|dnl))(?=[ \t\r\n])", re.MULTILINE)
_SEED = 0x2545F4914F6CDD1D

#: Notices by license.  Public standard wordings, in the order of their names.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
}

_GNU = (
    "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} Public License as "
    "published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version"
)
_LIBRARY = _GNU.replace("This program", "This library")
#: More licenses, and more wordings of the above.
_MORE = {
    "AGPL-3.0": (_GNU.format(":", "Affero General", ",", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    "Artistic-1.0": (),
    "BSD-2-Clause": (),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty",
    ),
    "EPL-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GFDL-1.3": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
        "Version 1.3 or any later version published by the Free Software Foundation",
    ),
    "GPL-2.0": (_GNU.format(";", "General", ";", "2"), "This work is licensed under the GNU General Public License, version 2."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    "LGPL-2.1": (_LIBRARY.format(";", "Lesser General", ";", "2.1"), "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    "LGPL-3.0": (_LIBRARY.format(":", "Lesser General", ",", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    ),
    "MPL-2.0": (),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
}
_LINES = (
    "Licensed under the {} License", "Released under the {} License", "Distributed under the {} License", "This project is licensed under the {} License",
    "SPDX-License-Identifier: {}",
)


def _templates() -> dict[str, tuple[str, ...]]:
    """Notices, lines with the license's name, and the full texts shipped beside
    this module.  The first templates of a license are those written first."""
    folder = resources.files(__package__).joinpath("license_texts")
    full = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    out = {}
    for name in sorted(TEMPLATES.keys() | _MORE.keys()):
        own = [*TEMPLATES.get(name, ()), *_MORE.get(name, ()), *(x.format(name) for x in _LINES)]
        own += [f"SPDX-License-Identifier: {name}-{x}" for x in ("only", "or-later") if "GPL" in name]
        out[name] = tuple(dict.fromkeys([*own, *([full[name]] if name in full else [])]))
    return out


TEMPLATES = _templates()


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words([_LEADER.sub(b" ", t).translate(_EDGE) for t in texts], lower=True)


def shingle_codes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Shingle hashes in order; fewer words than a shingle are one."""
    return ngrams(words, n) if len(words) >= n else ngrams(words, len(words))[: min(1, len(words))]


def bands_for(share: float, rows: int = 1, miss: float = MISS) -> int:
    """Bands of ``rows`` coordinates that miss a pair at ``share`` agreement with
    a chance of at most ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(share**rows)))) if share < 1 else 1


def _coordinate(shingles: np.ndarray, c: int) -> np.ndarray:
    return mix(shingles ^ np.uint64((_SEED * (2 * c + 1)) % 2**64))


class Templates:
    """Templates grouped by window length, with their band tables."""

    def __init__(self, rows: list[tuple[str, bytes]], percent: int = PERCENT, n: int = SHINGLE):
        codes, counts = word_codes([t for _, t in rows])
        self.names, self.percent, self.n = [name for name, _ in rows], percent, n
        words = np.split(codes, np.cumsum(counts)[:-1]) if rows else []
        self.sets = [np.unique(shingle_codes(w, n)) for w in words]
        self.shingle = [min(n, len(w)) for w in words]
        # Windows count shingles: one and a half times the longest of their class.
        self.classes: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                length = max(len(shingle_codes(words[i], n)), 1)
                self.classes.setdefault((self.shingle[i], 1 << (length - 1).bit_length()), []).append(i)
        self.tables = {}
        for (q, size), members in self.classes.items():
            width = size + size // 2 + 1
            smallest = min(len(self.sets[i]) for i in members)
            # Jaccard similarity of template and window at the least containment.
            share = percent / 100 * smallest / (width + smallest * (1 - percent / 100))
            bands = bands_for(share)
            tables = [{} for _ in range(bands)]
            for c in range(bands):
                for i in members:
                    tables[c].setdefault(int(_coordinate(self.sets[i], c).min()), []).append(i)
            self.tables[q, size] = width, bands, tables, smallest
        # Any window with a match shares a shingle with the template.
        self.known = {}
        for q in {k[0] for k in self.classes}:
            self.known[q] = np.unique(np.concatenate([s for s, own in zip(self.sets, self.shingle, strict=True) if own == q]))

    def found(self, words: np.ndarray) -> list[tuple[int, int, int, float, int, int, int]]:
        """(template, first word, end word, containment, rank, first and end word
        of where most of it lies), the best of one template's overlaps."""
        best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        found: dict[int, list[tuple[float, int, int]]] = {}
        for (q, size), (width, bands, tables, smallest) in self.tables.items():
            grams = ngrams(words, q)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(self.known[q], grams), len(self.known[q]) - 1)
            hits = np.flatnonzero(self.known[q][at] == grams)
            # A match has the share of the smallest template at least in hits.
            if not len(hits) or 100 * len(hits) < self.percent * smallest:
                continue
            stride = max(1, width - size)
            # Only windows with a shingle of some template can match.
            low = np.maximum(0, -(-(hits - width + 1) // stride))
            starts = np.unique(np.concatenate([low + k for k in range(-(-width // stride) + 1)]))
            starts = starts[(starts * stride < len(grams))] * stride
            within = np.searchsorted(hits, starts + width) - np.searchsorted(hits, starts)
            for s in starts[100 * within >= self.percent * smallest].tolist():
                window = np.unique(grams[s : s + width])
                seen = set()
                for c in range(bands):
                    seen.update(tables[c].get(int(_coordinate(window, c).min()), ()))
                for i in sorted(seen):
                    inside = np.isin(self.sets[i], window)
                    share = float(inside.mean())
                    if 100 * int(inside.sum()) >= self.percent * len(inside):
                        own = s + np.flatnonzero(np.isin(grams[s : s + width], self.sets[i]))
                        place = (-share, int(own[0]), int(own[-1]) + q)
                        found.setdefault(i, []).append(place)
                        # Where most of it lies: single shingles may be far off.
                        near = np.searchsorted(own, own + len(self.sets[i]) * 5 // 4 + 1) - np.arange(len(own))
                        a = int(near.argmax())
                        best[i, *place[1:]] = 2 * int(inside.sum()) - len(inside), int(own[a]), int(own[a + near[a] - 1]) + q
        out = []
        for i, rows in found.items():
            taken: list[tuple[int, int]] = []
            for share, a, b in sorted(rows):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((i, a, b, -share))
        return [(*m, *best[m[:3]]) for m in out]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        return best_of(self.found(words))


def best_of(found: Iterable[tuple[int, int, int, float, int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(template, first word, end word, containment): of the templates that match
    one stretch of text, that is where two overlap by more than half of the
    shorter, the best.  It has most of its shingles in the text, less those that
    it lacks there."""
    kept: list[tuple[tuple[int, int, int, float], int, int]] = []
    for *m, rank, a, b in sorted(found, key=lambda m: (-m[4], -m[3], m[1], m[0])):
        if all(2 * (min(b, y) - max(a, x)) <= min(b - a, y - x) for _, x, y in kept):
            kept.append((tuple(m), a, b))
    return sorted((m for m, _, _ in kept), key=lambda r: (r[1], r[0]))


def _blocks(rows: Iterable[tuple[str, bytes]], most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Templates by ``most`` and ``MAX_BYTES`` at once; a longer one is a block."""
    block, size = [], 0
    for row in rows:
        if block and (len(block) == most or size + len(row[1]) > MAX_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    if block:
        yield block


_FOUND = ("template", "start_word", "end_word", "containment", "rank", "a", "b")


def _scan(docs: DataFrame, block: list[tuple[str, bytes]], base: int, percent: int, settle: bool) -> DataFrame:
    """Of documents (doc_id, text): doc_id, license and the ``_FOUND`` columns,
    settled or not.  Templates are numbered from ``base``."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(sent.value, percent)
        for batch in in_parts(batches, 1):
            texts, got = text_bytes(batch.column(1)), []
            for begin, end in slices(texts):
                codes, counts = word_codes(texts[begin:end])
                # Most texts share no shingle with any template.
                for k, words in enumerate(np.split(codes, np.cumsum(counts)[:-1])):
                    found = known.found(words)
                    got += [(begin + k, *m, *(() if len(m) == 7 else (0, 0, 0))) for m in (best_of(found) if settle else found)]
            of, which, *rest = zip(*got, strict=True) if got else ((),) * 8
            types = pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array([known.names[i] for i in which], pa.string())]
            columns += [pa.array([base + i for i in which], pa.int32()), *(pa.array(x, t) for x, t in zip(rest, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", *_FOUND])

    fields = "license string, template int, start_word bigint, end_word bigint, containment double, rank bigint, a bigint, b bigint"
    return map_batches(docs, run, f"doc_id {kind}, {fields}")


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] | DataFrame | None = None,
    percent: int = PERCENT,
    max_templates: int = MAX_TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, license, template, start_word, end_word, containment per match.
    ``templates`` are wordings by license, or a table (license, text)."""
    if isinstance(templates, DataFrame):
        rows = ((r[0], (r[1] or "").encode()) for r in templates.select("license", "text").orderBy("license", "text").toLocalIterator())
    else:
        rows = ((name, t.encode()) for name, texts in (TEMPLATES if templates is None else templates).items() for t in texts)
    blocks = _blocks(rows, max_templates)
    first, second = next(blocks, []), next(blocks, None)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = ("license", "template", "start_word", "end_word", "containment")
    if second is None:
        return _scan(docs, first, 0, percent, True).select("doc_id", *wanted)
    # What different passes find in a text is settled once for each text.
    of_text = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed, base, found = docs.select(of_text.alias("doc_id"), "text"), 0, None
    for block in itertools.chain([first, second], blocks):
        part = _scan(keyed, block, base, percent, False)
        found, base = part if found is None else found.unionByName(part), base + len(block)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        names = dict(zip(pdf["template"], pdf["license"], strict=True))
        best = best_of(pdf[list(_FOUND)].itertuples(index=False, name=None))
        return pd.DataFrame([(pdf["doc_id"].iloc[0], names[m[0]], *m) for m in best], columns=["of_text", *wanted])

    settled = found.distinct().groupBy("doc_id").applyInPandas(settle, "of_text string, license string, template int, start_word bigint, end_word bigint, containment double")
    return docs.select("doc_id", of_text.alias("of_text")).join(settled, "of_text").select("doc_id", *wanted)


def op3_license_windows(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))

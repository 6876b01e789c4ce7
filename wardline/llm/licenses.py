"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units are the lines of a text and the whole text. A unit is reduced to its words ([A-Za-z0-9]+, lower case)
and those to the set of neighbouring pairs. Dice = 2 |A & B| / (|A| + |B|), at least `threshold`.

Pruning, without loss: a template with b pairs is compared with units of a pairs only if
b t / (2 - t) <= a <= b (2 - t) / t. And since a match shares at least b t / (2 - t) of the pairs, it contains
one of any b - that + 1 of them; texts with none of these words are not split at all.

Result: doc_id, n_hits (units that match some template), licenses (ids, sorted, comma-joined), best_dice (0.0
without a match). Null and empty texts match nothing; repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, texts

THRESHOLD = 0.8
# Wording of public licence notices.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORD = re.compile("[A-Za-z0-9]+")


def bigrams(unit: str) -> set[tuple[str, str]]:
    words = [w.lower() for w in _WORD.findall(unit)]
    return set(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        self.known = [(name, bigrams(t)) for name, t in templates.items()]
        self.known = [(name, pairs) for name, pairs in self.known if pairs]
        self.bounds = [self._bounds(len(pairs)) for _, pairs in self.known]
        self.smallest = min((low for low, _ in self.bounds), default=0)
        self.largest = max((high for _, high in self.bounds), default=-1)
        # Per template, enough pairs that every match has one; long words first, as they are rare.
        probes = set()
        for (_, pairs), (low, _) in zip(self.known, self.bounds):
            ranked = sorted(pairs, key=lambda p: (-max(map(len, p)), p))
            probes |= {max(p, key=len) for p in ranked[:len(pairs) - low + 1]}
        self.probes = sorted(w for w in probes if not any(v != w and v in w for v in probes))

    def _bounds(self, size: int) -> tuple[int, int]:
        ratio = self.threshold / (2 - self.threshold)
        return math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)

    def hits(self, unit: str) -> list[tuple[str, float]]:
        # n words make at most n - 1 pairs, and a word takes two characters with its separator.
        if len(unit) < 2 * self.smallest:
            return []
        own = bigrams(unit)
        if not self.smallest <= len(own) <= self.largest:
            return []
        found = []
        for (name, pairs), (low, high) in zip(self.known, self.bounds):
            if low <= len(own) <= high:
                dice = 2.0 * len(own & pairs) / (len(own) + len(pairs))
                if dice >= self.threshold:
                    found.append((name, dice))
        return found

    def scan(self, text: str) -> tuple[int, str, float]:
        lower = text.lower()
        if not any(w in lower for w in self.probes):
            return 0, "", 0.0
        units = text.split("\n")
        every = [h for u in (units if len(units) == 1 else [*units, text]) if (h := self.hits(u))]
        flat = [x for h in every for x in h]
        return len(every), ",".join(sorted({n for n, _ in flat})), max((d for _, d in flat), default=0.0)


def scan_documents(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for b in pieces(batches):
            found = [matcher.scan(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()),
                pa.array([x[2] for x in found], pa.float64())], ["doc_id", "n_hits", "licenses", "best_dice"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_hits long, licenses string, best_dice double")


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in templates.items())
    pairs = """list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))"""
    words = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x))"
    return f"""
WITH given(name, body) AS (VALUES {rows}),
templates AS (SELECT name, {pairs} AS pairs FROM (SELECT name, {words.format('body')} AS w FROM given) WHERE len(w) > 1),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS unit FROM docs
  UNION ALL SELECT row, doc_id, text FROM docs WHERE contains(text, chr(10))),
numbered AS (SELECT row, doc_id, row_number() OVER () AS unit_no, {words.format('unit')} AS w FROM units),
paired AS (SELECT row, doc_id, unit_no, {pairs} AS pairs FROM numbered WHERE len(w) > 1),
close AS (
  SELECT row, doc_id, unit_no, name, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice
  FROM paired p JOIN templates t ON len(p.pairs) * {2 - threshold} >= len(t.pairs) * {threshold} - 1e-6
    AND len(p.pairs) * {threshold} <= len(t.pairs) * {2 - threshold} + 1e-6),
hits AS (SELECT * FROM close WHERE dice >= {threshold}),
found AS (SELECT row, count(DISTINCT unit_no) AS n_hits, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
                 max(dice) AS best_dice FROM hits GROUP BY row)
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(licenses, '') AS licenses,
       coalesce(best_dice, 0.0)::DOUBLE AS best_dice
FROM docs LEFT JOIN found USING (row)
"""

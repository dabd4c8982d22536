"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance.

A template is a sparse vector of ``(1 + ln tf) * idf``; idf comes from the template collection, and words outside
it weigh like words of no template, so foreign text lowers a cosine.  Headers are windows of words anywhere in a
text, across line ends, so words before and after a notice don't count.  Only texts and windows with an anchor word
are compared: anchors are each template's heaviest words, so many that the rest's norm is under the threshold,
hence a window without them can't reach it (the prefix-filter bound).  A window begins where the template would begin if the
anchor stood at its place in it, and is as long as the template, a quarter longer or a fifth shorter.

A licence file (by name, or a text that is little but one licence) governs its directory.  A file's
licence is that of its own header, else that of the nearest directory above it that is governed:
directories are exploded into their ancestors once each and joined with the governed ones.

Defined results: a null or empty text has no header; a null path lies in no directory; repeated rows
pass through, a row each; several licence files in a directory: the best score, then the smallest
path; an empty table gives no rows; other columns play no part; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import ship, whole, written

#: Notices of public licences, (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work under CC0 1.0 Universal."),
)
THRESHOLD = 0.75
#: Share of a template's words that a window holds at least, so that one heavy word alone isn't a short notice.
HELD = 0.6
#: A text is a licence file if its best window has this share of its words.
MOSTLY = 0.8
NAMES = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
#: Words of any English text; they say nothing of a licence and are left out of all vectors.
COMMON = frozenset("a an and are as at be by can for from has have if in is it its may not of on one or see that the this to "
                   "under was where which will with without you your".split())
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.translate(_LOWER)) if w not in COMMON]


def lengths(n: int) -> list[int]:
    """Window lengths for a template of n words."""
    return sorted({n, n + n // 4, max(1, n - n // 5)})


class Templates:
    """Template vectors, idf and anchors."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [n for n, _ in templates], threshold
        bags = [Counter(words(t)) for _, t in templates]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: math.log((len(bags) + 1) / (n + 0.5)) for w, n in df.items()}
        self.other = math.log((len(bags) + 1) / 0.5)
        self.vectors, anchors = [], set()
        self.places: dict[str, list[tuple[int, int]]] = {}  # anchor -> (its place in a template, the template's words)
        self.index: dict[str, list[tuple[int, float]]] = {}
        for i, b in enumerate(bags):
            v = {w: (1 + math.log(n)) * self.idf[w] for w, n in b.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.vectors.append(v)
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda a: -a[1]):
                if rest < threshold ** 2 * 0.999:
                    break
                anchors.add(w)
                rest -= x * x
            for w, x in v.items():
                self.index.setdefault(w, []).append((i, x))
        self.anchors = frozenset(anchors)
        for _, t in templates:
            sequence = words(t)
            for at, w in enumerate(sequence):
                if w in anchors and (at, len(sequence)) not in self.places.setdefault(w, []):
                    self.places[w].append((at, len(sequence)))
        # the bounds of a word as in words(): an underscore isn't part of one
        self.pattern = r"(?i)(?<![a-z0-9])(" + "|".join(re.escape(a) for a in sorted(anchors)) + r")(?![a-z0-9])"

    def best(self, bag: Counter) -> tuple[float, int]:
        """Largest cosine and its template (the first of equals)."""
        norm, dots = 0.0, {}
        for w, n in bag.items():
            x = (1 + math.log(n)) * self.idf.get(w, self.other)
            norm += x * x
            for i, y in self.index.get(w, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        if not dots:
            return 0.0, -1
        i = min(dots, key=lambda k: (-dots[k], k))
        return dots[i] / math.sqrt(norm), i

    def header(self, text: str) -> tuple[str, float, int, int, float] | None:
        """The best window: licence, cosine, first line, lines, its share of the text's words."""
        of_line = [words(x) for x in text.split("\n")]
        flat = [w for x in of_line for w in x]
        starts = {(p - at, size) for p, w in enumerate(flat) if w in self.anchors for at, n in self.places[w] for size in lengths(n)
                  if 0 <= p - at <= len(flat) - size}
        best = None
        for first, size in sorted(starts):
            bag = Counter(flat[first:first + size])
            c, i = self.best(bag)
            if c >= self.threshold and (best is None or c > best[1] + 1e-12) and len(bag.keys() & self.vectors[i].keys()) >= HELD * len(self.vectors[i]):
                best = (self.names[i], c, first, size)
        if best is None:
            return None
        ends = list(accumulate(map(len, of_line)))
        line, last = bisect_right(ends, best[2]), bisect_right(ends, best[2] + best[3] - 1)
        return best[0], best[1], line, last - line + 1, best[3] / len(flat)


FOUND = "license string, score double, first_line int, lines int, share double"


def scan(files: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Adds license, score, first_line, lines and share (null without a header) to key and path."""
    ship(files.sparkSession)
    t = Templates(threshold=threshold)
    kind = files.schema[key].dataType.simpleString()
    text = F.when(whole("text").rlike(t.pattern), F.col("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.header(x) if x else None for x in batch.column(2).to_pylist()]
            cols = list(zip(*[f or (None,) * 5 for f in found])) or [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["key", "path", *[x.split()[0] for x in FOUND.split(", ")]])

    return files.select(F.col(key).alias("key"), "path", text.alias("text")).mapInArrow(
        look, f"key {kind}, path string, {FOUND}").withColumnRenamed("key", key)


def directory(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """Adds effective (the file's own licence or the nearest governed directory's) and origin
    (that directory, null for a header of its own)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = found.withColumn("dir", directory(F.col("path")))
    rules = found.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (name.rlike(NAMES) | (F.col("share") >= MOSTLY)))
    governed = rules.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("r"))
    governed = written(governed.select(F.col("dir").alias("above"), F.col("r.license").alias("given")), "governed")
    dirs = found.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    ways = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.above").where(
        (F.col("depth") > 0) | (F.col("above") == "")).distinct()
    near = ways.join(governed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    near = written(near.select(F.col("dir").alias("_dir"), F.col("n.above").alias("above"), F.col("n.given").alias("given")), "near")
    own = F.col("license").isNotNull()
    return found.join(near, F.col("dir") == F.col("_dir"), "left").withColumn(
        "effective", F.coalesce("license", "given")).withColumn("origin", F.when(~own, F.col("above"))).drop(
        "_dir", "above", "given", "dir")


def licenses(files: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """``files``: key, path, text."""
    return inherit(written(scan(files, threshold, key), "headers"))

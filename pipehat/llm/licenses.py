"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory above.

What is compared with the templates, as sparse TF-IDF vectors, are all lines, licence blocks (whole runs of adjacent lines that hold an anchor), whole texts,
and of every template all windows of as many words as it has, wherever they begin: prose around a notice, or a sentence in the middle of a line, does not dilute it.
Few of them are weighed word by word. The product of a stretch with a template is a sum over its places, and its length is at
least that of a text in which no word repeats; so differences of running sums bound the cosine of any stretch from above, for a whole batch at
once, and only stretches whose bound reaches the threshold are weighed. Anchors are enough of a template's weightiest words that a line without any can't reach it.

A directory's licence is the one that its licence files, or else most of its files' headers name. Files
without a licence of their own get that of the nearest directory at or above their own; that is a join
of the distinct directories' ancestors with the directories that have one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, documents, text_bytes, written
from .words import word_hashes, words

COSINE = 0.7
SLICE_BYTES = 2 << 20
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"
#: A licence file says more about its directory than any number of headers.
FILE_VOTE = 1 << 40
SALTS = 16

# What headers and licence files say.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    anchors: np.ndarray
    known: np.ndarray  # the sorted words of all templates
    weights: np.ndarray  # the weight of one place that holds each of them, and of an unknown word
    directions: np.ndarray  # the templates' vectors of length 1 over these words
    sizes: tuple[int, ...]  # the words of each template


@functools.cache
def model(templates: tuple[tuple[str, str], ...] = TEMPLATES, cosine: float = COSINE) -> Model:
    counts = [Counter(word_hashes(t.encode()).tolist()) for _, t in templates]
    n, df = len(counts), Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    vectors, anchors = [], set()
    for c in counts:
        v = {w: k * idf[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        v = {w: x / norm for w, x in v.items()}
        vectors.append(v)
        left = 1.0
        for w in sorted(v, key=lambda w: (-v[w], w)):
            if math.sqrt(max(left, 0)) < cosine - 1e-9:
                break
            anchors.add(w)
            left -= v[w] ** 2
    rare, known = math.log(1 + n) + 1, sorted(idf)
    weights = np.array([*(idf[w] for w in known), rare])
    directions = np.array([[v.get(w, 0.0) for w in [*known, None]] for v in vectors])
    return Model(tuple(k for k, _ in templates), np.array(sorted(anchors), np.uint64), np.array(known, np.uint64), weights, directions, tuple(sum(c.values()) for c in counts))


def best(m: Model, hashes: np.ndarray) -> tuple[float, str]:
    """The highest cosine of a text of these words to a template, and whose it is; of equal ones, the first name."""
    own, counts = np.unique(hashes, return_counts=True)
    at = np.minimum(np.searchsorted(m.known, own), len(m.known) - 1)
    code = np.where(m.known[at] == own, at, len(m.known))
    weights = counts * m.weights[code]
    norm = math.sqrt(float(weights @ weights))
    scores = np.round(m.directions[:, code] @ weights / norm, 9) if norm else np.zeros(len(m.names))
    return float(scores.max()), min(m.names[k] for k in np.flatnonzero(scores == scores.max()))


def matches(m: Model, data: np.ndarray, offsets: np.ndarray, cosine: float = COSINE) -> list[tuple[float, str | None, float, str | None]]:
    """For each text: the best licence among its lines, blocks and windows, and that of the whole text; null below ``cosine``."""
    own = words(data, offsets)
    n_rows, n = len(offsets) - 1, len(own.hashes)
    tops: list[tuple[float, str | None]] = [(0.0, None)] * n_rows
    wholes = list(tops)
    if not n:
        return [(0.0, None, 0.0, None)] * n_rows
    at = np.minimum(np.searchsorted(m.known, own.hashes), len(m.known) - 1)
    code = np.where(m.known[at] == own.hashes, at, len(m.known))
    row = np.repeat(np.arange(n_rows), np.diff(own.rows))
    # lines: stretches of words between line ends, within a text; blocks: runs of adjacent lines with an anchor
    line = np.searchsorted(np.flatnonzero(data == 10), own.starts)
    heads = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
    tails = np.concatenate([heads[1:], [n]])
    place = np.minimum(np.searchsorted(m.anchors, own.hashes), len(m.anchors) - 1)
    anchored = np.logical_or.reduceat(m.anchors[place] == own.hashes, heads)
    heads, tails = heads[anchored], tails[anchored]
    follows = (line[heads[1:]] == line[heads[:-1]] + 1) & (row[heads[1:]] == row[heads[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~follows])) if len(heads) else np.empty(0, np.int64)
    last = np.concatenate([first[1:], [len(heads)]]) - 1 if len(heads) else first
    filled = np.flatnonzero(np.diff(own.rows))
    units = np.stack([np.concatenate([heads, heads[first], own.rows[filled]]), np.concatenate([tails, tails[last], own.rows[filled + 1]])])
    is_whole = np.arange(units.shape[1]) >= units.shape[1] - len(filled)
    squares = np.concatenate([[0.0], np.cumsum(m.weights[code] ** 2)])
    least = (cosine - 1e-6) * np.sqrt(squares[units[1]] - squares[units[0]])
    worth = np.zeros(units.shape[1], bool)
    windows = []
    for share, size in zip(m.directions * m.weights, m.sizes, strict=True):
        total = np.concatenate([[0.0], np.cumsum(share[code])])
        worth |= total[units[1]] - total[units[0]] >= least
        if size <= n:
            begin = np.flatnonzero(total[size:] - total[:-size] >= (cosine - 1e-6) * np.sqrt(squares[size:] - squares[:-size]))
            windows.append(np.stack([begin, begin + size])[:, row[begin] == row[begin + size - 1]])
    better = lambda new, old: new[0] >= cosine and (new[0] > old[0] or new[0] == old[0] and (old[1] is None or new[1] < old[1]))
    inner = np.unique(np.concatenate([units[:, worth & ~is_whole], *windows], axis=1), axis=1)
    for places, into in ((inner, tops), (units[:, worth & is_whole], wholes)):
        for a, b in places.T.tolist():
            score = best(m, own.hashes[a:b])
            if better(score, into[row[a]]):
                into[row[a]] = score
    return [(*t, *w) for t, w in zip(tops, wholes, strict=True)]


def own_licenses(files: DataFrame) -> DataFrame:
    """(doc_id, path, own_license, own_score, is_file) for every row of ``files`` (doc_id, path, text)."""
    m = model()
    pattern = re.compile(FILE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                found = matches(m, *text_bytes(part.column(2)))
                paths = part.column(1).to_pylist()
                names = [w or t for _, t, _, w in found]
                scores = [ws if w else ts for ts, _, ws, w in found]
                is_file = [bool(w) or bool(n and pattern.match((p or "").rpartition("/")[2])) for p, n, (_, _, _, w) in zip(paths, names, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array([round(s, 6) for s in scores], pa.float64()), pa.array(is_file, pa.bool_())], ["doc_id", "path", "own_license", "own_score", "is_file"])

    return files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), "text").mapInArrow(run, "doc_id long, path string, own_license string, own_score double, is_file boolean")


def licensed(files: DataFrame) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, declared_in) for every row of ``files`` (doc_id, path, text).

    ``license`` is the file's own or that of the nearest directory at or above its own that has one;
    ``declared_in`` is that directory, null for a file's own. Of equally many headers, and of equal cosines, the first name
    counts. Null and empty texts have no licence of their own; a null path lies in the root ''. Repeated
    rows each count and each get a row. Very long texts are scanned whole, a slice of a batch each. Only doc_id, path and text are read, so other
    columns may have any name. An empty table gives an empty result.
    """
    directory = F.coalesce(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit(""))
    rows = written(own_licenses(files).withColumn("directory", directory), "own")
    votes = rows.where("own_license is not null").groupBy("directory", "own_license").agg(F.sum(F.when(F.col("is_file"), F.lit(FILE_VOTE)).otherwise(F.lit(1))).alias("votes"))
    # of the most votes, the first name: the least of (-votes, name)
    declared = votes.groupBy("directory").agg(F.min(F.struct(-F.col("votes"), F.col("own_license").alias("name"))).alias("first"))
    declared = declared.select(F.col("directory").alias("above"), F.col("first.name").alias("name"))
    asked = rows.where("own_license is null").select("directory").distinct()
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    nearest = asked.select("directory", F.explode(F.array_distinct(above)).alias("step")).join(declared, F.col("step") == F.col("above"))
    nearest = nearest.groupBy("directory").agg(F.max(F.struct(F.length("above"), "above", "name")).alias("last"))
    nearest = nearest.select(F.col("directory").alias("own_directory"), F.col("last.above").alias("near"), F.col("last.name").alias("near_name"))
    # a directory may hold most rows: they are dealt over SALTS keys, and the few directories with an answer go to each
    salted = nearest.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int"))
    out = rows.join(salted, F.col("own_license").isNull() & (F.col("directory") == F.col("own_directory")) & (F.col("salt") == F.col("own_salt")), "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "near_name").alias("license"), F.col("near").alias("declared_in"))


def document_path():
    """A path for a document: its source, and for two in three its language, and for one in three a numbered folder."""
    n = F.coalesce(F.col("doc_id"), F.lit(0))
    parts = [F.coalesce(F.col("source"), F.lit("none")), F.when(n % 3 > 0, F.coalesce(F.col("lang"), F.lit("none"))), F.when(n % 3 > 1, F.lpad((n % 100).cast("string"), 2, "0"))]
    return F.concat_ws("/", *parts, F.concat(n.cast("string"), F.lit(".txt")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document; see ``licensed`` for nulls, empty and very long texts, ties and repeated rows."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    return licensed(docs.select("doc_id", document_path().alias("path"), "text"))

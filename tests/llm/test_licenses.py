import math
import re
from collections import Counter

import numpy as np

from pipehat.llm import licenses


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def plain_best(text):
    counts = [Counter(tokens(t)) for _, t in licenses.TEMPLATES]
    n, df = len(counts), Counter(w for c in counts for w in c)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    own = Counter(tokens(text))
    dot = lambda a, b: sum(k * b.get(w, 0) * idf(w) ** 2 for w, k in a.items())
    if not own:
        return 0.0, None
    scores = [(dot(c, own) / math.sqrt(dot(c, c) * dot(own, own)), name) for c, (name, _) in zip(counts, licenses.TEMPLATES, strict=True)]
    return max(scores, key=lambda x: round(x[0], 9))


def plain_own(text):
    lines, m = (text or "").split("\n"), licenses.model()
    anchored = [bool({int(x) for x in licenses.word_hashes(li.encode())} & {int(x) for x in m.anchors}) for li in lines]
    units, k = [*lines, text or ""], 0
    while k < len(lines):
        stop = k
        while stop < len(lines) and anchored[stop]:
            stop += 1
        units.append("\n".join(lines[k:stop]))
        k = max(stop, k + 1)
    own = tokens(text or "")
    # of the windows, those that share words enough to reach the threshold: three of ten, by count
    for _, t in licenses.TEMPLATES:
        goal = set(tokens(t))
        size = len(tokens(t))
        inside = [w in goal for w in own]
        total = sum(inside[:size])
        for a in range(len(own) - size + 1):
            if total >= 0.3 * size:
                units.append(" ".join(own[a : a + size]))
            total += (a + size < len(own) and inside[a + size]) - inside[a]
    score, name = max((plain_best(u) for u in units), key=lambda x: round(x[0], 9))
    return name if score >= licenses.COSINE else None


TEXTS = [
    "Some words.\nReleased under the MIT License.\nMore words of this.", "Licensed under CC BY-NC 4.0.", "licensed under the apache license version 2.0", "plain words of the text", "", None,
    "x\nThis program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free Software\nFoundation, either version 3 of the License, or (at your option) any later version.\ny",
    "SPDX-License-Identifier: BSD-3-Clause\ncode", "This work is licensed under the GNU General Public License, version 2.", "the license of the work was released in a new version under the public eye of many people who read this",
]


def test_gate_loses_nothing():
    m = licenses.model()
    rng = np.random.default_rng(0)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in tokens(t)}) + [f"z{i}" for i in range(30)]
    lines = [" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(1500)]
    for _, t in licenses.TEMPLATES:
        w = tokens(t)
        lines += [" ".join(x for x in w if rng.random() < 0.8) + " extra" for _ in range(10)]
    data = "".join(lines).encode()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    got = licenses.matches(m, np.frombuffer(data, np.uint8), offsets)
    for text, (part, _, score, name) in zip(lines, got, strict=True):
        want, _ = plain_best(text)
        assert part >= score - 1e-9
        assert (name is not None) == (want >= licenses.COSINE) or abs(want - licenses.COSINE) < 1e-6, text
        assert name is None or abs(score - want) < 1e-6


def test_own_licenses(spark):
    df = spark.createDataFrame([(i, "a/b.txt", t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, path string, text string, directory string")
    got = {r.doc_id: r.own_license for r in licenses.own_licenses(df).collect()}
    assert got == {i: plain_own(t) for i, t in enumerate(TEXTS)}
    assert got[6] == "GPL-3.0" and got[9] is None


def test_notices_among_prose():
    notice = TEXTS[6].split("\n")[1:4]
    flowing = " ".join(notice).split(" ")
    wrapped = [" ".join(flowing[k : k + 7]) for k in range(0, len(flowing), 7)]
    prose = "the people of the town went to the market for the week and it was the end of it"
    texts = ["\n".join([prose] * 3 + wrapped + [prose] * 3), f"{prose} {TEXTS[8]} {prose}", f"{prose} Licensed under CC BY 4.0. {prose}", prose]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got = licenses.matches(licenses.model(), np.frombuffer(data, np.uint8), offsets)
    assert [name for _, name, _, _ in got] == ["GPL-3.0", "GPL-2.0", "CC-BY-4.0", None]


def test_whole_licence_texts():
    for name, t in licenses.TEMPLATES:
        data = f"Copyright (c) 2020 by them\n\n{t}\n".encode()
        (_, part, score, whole), = licenses.matches(licenses.model(), np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert part == name and (len(tokens(t)) < 100 or whole == name), (t, part, whole)


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.own_license for r in licenses.op6_licenses(spark, sf).collect()}
    assert got == {i: plain_own(t) for i, t in texts.items()}


def test_very_long_text_and_clashing_columns(spark):
    long = "plain words of a text\n" * 60_000 + "Released under the MIT License.\n" + "more " * 90_000
    rows = [(1, "a/b/x.txt", long, "own", "dir"), (2, "a/b/y.txt", "words", "own", "dir"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, own_license string, directory string")
    assert {r.doc_id: (r.license, r.declared_in) for r in licenses.licensed(df).collect()} == {1: ("MIT", None), 2: ("MIT", "a/b"), 3: (None, None)}


def test_inheritance(spark):
    mit, apache, plain = TEXTS[0], f"some other words here\n{TEXTS[2]}\nand many others", "words"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.txt", apache), (3, "a/y.txt", apache), (4, "a/z.txt", plain), (5, "a/b/c/w.txt", plain), (6, "a/b/v.txt", plain), (7, "a/b/u.txt", apache),
        (8, "d/e.txt", plain), (9, None, plain), (None, "a/b/c/w.txt", None), (5, "a/b/c/w.txt", plain), (10, "t/1", mit), (11, "t/2", apache), (12, "t/3", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {str(r.doc_id): (r.license, r.declared_in) for r in licenses.licensed(df).collect()}
    assert got == {
        "1": ("MIT", None), "2": ("Apache-2.0", None), "3": ("Apache-2.0", None), "4": ("MIT", "a"), "5": ("Apache-2.0", "a/b"), "6": ("Apache-2.0", "a/b"), "7": ("Apache-2.0", None),
        "8": (None, None), "9": (None, None), "None": ("Apache-2.0", "a/b"), "10": ("MIT", None), "11": ("Apache-2.0", None), "12": ("Apache-2.0", "t"),
    }
    assert licenses.licensed(df).count() == len(rows) and licenses.licensed(df.limit(0)).collect() == []
    root = licenses.licensed(spark.createDataFrame([(1, "LICENSE", mit), (2, "q/w/e.txt", plain)], "doc_id long, path string, text string"))
    assert {r.doc_id: (r.license, r.declared_in) for r in root.collect()} == {1: ("MIT", None), 2: ("MIT", "")}


def test_query_finds_the_planted_lines(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.own_license for r in licenses.op6_licenses(spark, sf).collect()}
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = [n for mark, n in names.items() if re.search(mark, r.text)]
        assert got[r.doc_id] in (want or [None]), (r.doc_id, got[r.doc_id], want)

import numpy as np

import corpus_pipeline as cp
from pipehat.llm import simhash_sets as sets

SF = "/root/testdata/sf0.01"


def plain_shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def groups(df):
    return {r.doc_id: r.component_id for r in sets.near_duplicates(df).collect()}


def parts(n, edges):
    """The smallest node reachable over ``edges``, of each of ``n`` nodes."""
    root, changed = list(range(n)), True
    while changed:
        changed = False
        for i, j in edges:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return root


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (4, 2)).astype(np.uint64)
    fps = base[rng.integers(0, 4, 150)]
    for _ in range(50):
        fps[np.arange(150), rng.integers(0, 2, 150)] ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    distance = lambda i, j: sum(bin(int(x)).count("1") for x in fps[i] ^ fps[j])
    planes = sets.planes_of(fps)
    for shift in (1, 63, 64, 70, 149):
        live = np.arange(150 - shift) % 7 != 3
        want = [i for i in range(150 - shift) if live[i] and distance(i, i + shift) <= sets.RADIUS]
        assert sets.at_shift(planes, shift, live).tolist() == want
    queries = np.array([3, 64, 149])
    live = rng.random((3, 150)) < 0.8
    got = sets.of_queries(planes, queries, live)
    assert [g.tolist() for g in got] == [[j for j in range(150) if live[k, j] and distance(q, j) <= sets.RADIUS] for k, q in enumerate(queries)]
    for radius in (0, 1, 7, 30, 63):
        differ = lambda rows, at: planes[rows, at]
        got = sets._lanes(sets.within(differ, sets._packed(np.ones(150, bool)), radius)).tolist()
        assert got == [i for i in range(150) if sum(bin(int(x)).count("1") for x in fps[i]) <= radius]


def test_close_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    own = rng.integers(0, 6, 400)
    fps = base[own]
    for _ in range(12):
        fps[np.arange(400), rng.integers(0, 2, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    groups = np.repeat([0, 1, 2], [150, 30, 220])
    distance = lambda i, j: sum(bin(int(x)).count("1") for x in fps[i] ^ fps[j])
    every = {(i, j) for i in range(400) for j in range(i + 1, 400) if groups[i] == groups[j] and distance(i, j) <= sets.RADIUS}
    sizes = np.full(400, 50)

    def joined(pairs, labels):
        first = {}
        return parts(400, [*pairs, *((i, first.setdefault((groups[i], labels[i]), i)) for i in range(400))])

    forest = sets.close_pairs(groups, fps, sizes, np.arange(400))
    assert set(forest) <= every and len(forest) == 400 - len({(g, o) for g, o in zip(groups, own)})
    labels = own // 2  # two bases share a label
    assert sets.close_pairs(groups, fps, sizes, labels) == [] == [p for p in every if labels[p[0]] != labels[p[1]]]
    labels = np.arange(400) // 3
    assert joined(sets.close_pairs(groups, fps, sizes, labels), labels) == joined(every, labels)
    sizes = np.where(np.arange(400) % 2, 50, 100)
    got = sets.close_pairs(groups, fps, sizes, np.arange(400))
    assert joined(got, np.arange(400)) == joined({(i, j) for i, j in every if i % 2 == j % 2}, np.arange(400))


def test_similar_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 9, 40, 90):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        own = []
        for _ in range(n):
            x, k = base.copy(), int(rng.integers(0, 14))
            x[:k] = rng.integers(0, 1 << 60, k)
            own.append(np.unique(rng.permutation(x)[: int(rng.integers(50, 61))]))
        every = {(i, j) for j in range(n) for i in range(j) if sets.close(own[i], own[j])}
        for labels in (list(range(n)), [i // 4 for i in range(n)]):
            got = sets.similar_pairs(own, labels)
            assert set(got) <= every

            alike = [(i, labels.index(labels[i])) for i in range(n)]
            assert parts(n, [*got, *alike]) == parts(n, [*every, *alike])


def test_tables_meet():
    """Pairs at the expected distance meet in a table nearly always, at any size of the corpus."""
    rng = np.random.default_rng(1)
    for n in (0, 10**6, 10**9):
        masks = [(a % (1 << 64)) | (b % (1 << 64)) << 64 for a, b in sets.tables(n)]
        assert len({bin(m).count("1") for m in masks}) == 1
        differing = [sum(1 << int(p) for p in rng.choice(128, 19, replace=False)) for _ in range(400)]
        assert sum(any(not m & d for m in masks) for d in differing) >= 398


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_components({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert groups(docs) == want
    kept = cp.one_of_each(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_edited_texts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts, i = {}, 0
    for _ in range(8):
        base = [f"w{x}" for x in rng.integers(0, 400, 120)]
        for k in range(30):  # a chain, and edits from few to too many
            words = list(base)
            for p in rng.choice(120, k % 6, replace=False):
                words[p] = f"new{p}"
            texts[i] = " ".join(words) + (" tail words" * (k % 3))
            i += 1
        texts[i] = " ".join(base).upper() + "\n"
        i += 1
    texts |= {900: "", 901: None, 902: " \n", 903: "one", 904: "ONE", 905: "one two", 906: "x " * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert groups(df) == plain_components(texts)
    for limits in ((5, 8192), (8192, 10), (5, 10)):
        assert {r.doc_id: r.component_id for r in sets.near_duplicates(df, *limits).collect()} == plain_components(texts), limits
    assert sets.near_duplicates(df.limit(0)).collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long), (2, long), (2, "another text of the second id"), (3, "its first text here"), (3, "its second text here"),
        (3, "its first text here"), (None, long), (None, "no id but a copy"), (None, "no id but a copy"), (None, "alone without id"), (None, None),
        (5, "near " + long), (5, "far from all the others"), (None, "NO id but\ta copy"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, (r.text or "none").lower().split()) for r in cp.one_of_each(spark, docs, SF).collect()]
    want = [(1, long), (2, "another text of the second id"), (3, "its first text here"), (3, "its second text here"), (5, "far from all the others")]
    want += [(None, "no id but a copy"), (None, "alone without id"), (None, "none")]
    assert sorted(kept, key=str) == sorted(((i, t.split()) for i, t in want), key=str)

import re

import numpy as np

from pipehat.llm import decontaminate as dc
from pipehat.llm.words import words


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\xff]+", "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in text).encode().decode("latin-1"))


def plain_distance(item, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(doc):
            new.append(min(row[j] + (w != v), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def corpus(seed=0, items=30, docs=150):
    rng = np.random.default_rng(seed)
    common = ["the", "of", "and", "a", "in", "Été", "x1"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "w" + str(rng.integers(400))
    bench = [[word() for _ in range(rng.integers(6, 70))] for _ in range(items)]
    out = []
    for _ in range(docs):
        body = [word() for _ in range(rng.integers(0, 120))]
        for _ in range(rng.integers(0, 3)):
            goal = list(bench[rng.integers(items)])
            for _ in range(rng.integers(0, int(0.27 * len(goal)) + 1)):
                k = rng.integers(len(goal))
                kind = rng.integers(3)
                goal[k : k + 1] = [[word()], [], [goal[k], word()]][kind]
                goal = goal or [word()]
            at = rng.integers(len(body) + 1)
            body[at:at] = goal
        out.append(rng.choice([" ", ", ", ".\n"]).join(body).title() if rng.random() < 0.3 else " ".join(body))
    return [" ".join(b) for b in bench], out


def test_words():
    texts = ["", "Été ÉTÉ  été", "a-b_c d", "end", "End of", "×÷ x", "y" * 3000]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = words(np.frombuffer(data, np.uint8), offsets)
    assert np.diff(got.rows).tolist() == [len(plain_words(t)) for t in texts]
    h = got.hashes
    assert h[0] == h[1] == h[2] and h[3] != h[4] and h[got.rows[3]] == h[got.rows[4]]


def test_infix_distance():
    rng = np.random.default_rng(3)
    for _ in range(30):
        item, docs = rng.integers(1, 5, 6).astype(np.uint64), rng.integers(1, 5, (4, 11)).astype(np.uint64)
        assert dc.infix_distance(item, docs)[0].tolist() == [plain_distance(item, d) for d in docs]


def test_recall_and_exactness(spark):
    bench, docs = corpus()
    goals, own = [plain_words(b) for b in bench], [plain_words(d) for d in docs]
    want = {(i, k): d for i, o in enumerate(own) for k, g in enumerate(goals) if (d := plain_distance(g, o)) <= dc.edits(len(g))}
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.contaminated(df, items).collect()}
    assert got.items() <= want.items()
    edited = [k for k, d in want.items() if d]
    assert len(edited) > 50 and len(set(want) & set(got)) / len(want) >= 0.97, (len(want), len(got))
    assert all(k in got for k, d in want.items() if not d)
    left = {r.doc_id for r in dc.clean(df, items).collect()}
    assert left == set(range(len(docs))) - {i for i, _ in got}


def spread(goal, kinds, offset):
    """``goal`` with one edit of each kind (0 replaced, 1 left out, 2 a word put in), evenly spread."""
    out, n = list(goal), len(kinds)
    for k in reversed(range(n)):
        at = (offset + (2 * k + 1) * len(goal) // (2 * n)) % len(goal)
        at = min(at, len(out) - 1)
        out[at : at + 1] = [[f"new{k}"], [], [out[at], f"new{k}"]][kinds[k]]
    return out


def test_boundary_lengths():
    """Items that allow one edit more than a shorter one of their class, with all their edits evenly spread, alone and among others."""
    rng = np.random.default_rng(11)
    tried = caught = 0
    for short, long in ((9, 10), (14, 15), (19, 20), (24, 25), (29, 30)):
        texts = [[f"a{n}x{k}" for k in range(n)] for n in (long, short, short - 1, long + 1)]
        alone, among = dc.prepare([(0, " ".join(texts[0]).encode())]), dc.prepare([(i, " ".join(t).encode()) for i, t in enumerate(texts)])
        n_edits = dc.edits(long)
        assert n_edits == dc.edits(short) + 1
        every = [tuple(rng.integers(0, 3, n_edits)) for _ in range(60)] + [(k,) * n_edits for k in range(3)]
        for kinds in every:
            body = [f"b{k}" for k in range(7)] + spread(texts[0], kinds, int(rng.integers(3))) + [f"c{k}" for k in range(9)]
            text = " ".join(body).encode()
            want = {i for i, t in enumerate(texts) if plain_distance(t, body) <= dc.edits(len(t))}
            own = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            got = {i: d for _, i, d, _ in dc.found(among, own.hashes, own.rows)}
            ids = {among.ids[i]: d for i, d in got.items()}
            assert all(d == plain_distance(texts[i], body) for i, d in ids.items()) and set(ids) <= want
            single = {d for _, _, d, _ in dc.found(alone, own.hashes, own.rows)}
            assert (0 in ids) == bool(single)
            tried, caught = tried + len(want), caught + len(ids)
    assert tried > 250 and caught >= 0.99 * tried, (tried, caught)


def test_short_items_are_found_exactly():
    items = dc.prepare([(1, b"yes"), (2, b"Alpha beta"), (3, b"one two three four"), (4, b"alpha BETA"), (5, b""), (6, b"!?"), (7, "日本語".encode())])
    texts = ["alpha", "beta yes", "x alpha beta y alpha beta", "one two three five", "0 one two three four", "", "das 日本語 x"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    own = words(np.frombuffer(data, np.uint8), offsets)
    got = [(r, items.ids[i], d, e) for r, i, d, e in dc.found(items, own.hashes, own.rows)]
    assert sorted(got) == [(1, 1, 0, 2), (2, 2, 0, 3), (2, 4, 0, 3), (4, 3, 0, 5), (6, 7, 0, 2)]


def test_real_items_at_their_last_edit(spark):
    """Every item of the table that a document holds at exactly its most edits is found as if it were the only one."""
    sf = "/root/testdata/sf0.01"
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {}
    for i, t in bench.items():
        goal = [w.encode("latin-1").decode() for w in plain_words(t)]
        docs[i] = " ".join(["before"] * 3 + spread(goal, [0] * dc.edits(len(goal)), 1) + ["after"] * 3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.contaminated(df, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {i for i in bench if plain_distance(plain_words(bench[i]), plain_words(docs[i])) <= dc.edits(len(plain_words(bench[i])))}
    assert len(want) == len(bench) and len([i for i in want if (i, i) in got]) >= 0.99 * len(want)
    assert all((i, i) in got for i in (27, 33, 37) if i in bench)


def test_blocks_and_odd_rows(spark, monkeypatch):
    bench, docs = corpus(1, 12, 40)
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, bench[0] + " more"), (900, None), (901, ""), (902, "word " * 50_000 + bench[3]), (902, "word " * 50_000 + bench[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(bench), (77, "so short"), (78, None), (79, ""), (80, bench[3])], "item_id long, text string")
    one = sorted(map(str, dc.contaminated(df, items).collect()))
    monkeypatch.setattr(dc, "ITEM_BYTES", 400)
    assert sorted(map(str, dc.contaminated(df, items).collect())) == one
    got = dc.contaminated(df, items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} >= {(None, 0, 0), (902, 3, 0), (902, 80, 0)} and sum(r.doc_id == 902 and r.item_id == 3 for r in got) == 2
    assert dc.contaminated(df.limit(0), items).collect() == [] and dc.contaminated(df, items.limit(0)).collect() == []
    assert dc.clean(df, items.limit(0)).count() == len(rows)
    bad = {r.doc_id for r in got}
    assert sorted(str(r.doc_id) for r in dc.clean(df, items).collect()) == sorted(str(i) for i, _ in rows if i not in bad)

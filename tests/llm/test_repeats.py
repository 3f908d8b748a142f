import hashlib

import numpy as np

from pipehat.llm import repeats

L = repeats.LENGTH


def plain(docs: list[tuple[int, bytes]]):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - L + 1):
            w = text[i : i + L]
            if w in seen:
                gone[i : i + L] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc_id] = (len(text), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é"[: 2 + i % 4] for i in range(300)]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 300, n))
    passages = [text(60) for _ in range(6)]
    docs = []
    for i in range(70):
        parts = [text(rng.integers(0, 90))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(6)]
            a = rng.integers(0, 40)
            parts += [p[a : a + rng.integers(80, 200)], text(rng.integers(0, 40))]
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "ab" * 400), (103, "x" * 99), (104, "x" * 100), (105, "x" * 350), (106, ""), (107, docs[3][1] + " tail " + docs[3][1])]
    docs += [(200 + i, f"unlike start {i * i} " + passages[0] + f" and then {i}") for i in range(12)]
    return docs


def test_index_against_sets():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(97, 100, 60).astype(np.uint8).tobytes()
        segments = [base[a : a + rng.integers(5, 40)] for a in rng.integers(0, 40, 25)] + [b"aaaaaaaaaaaa", b"zz\x00\x00zz\x00\x00zz"]
        seen, want, at = set(), [], 0
        for s in segments:
            for i in range(len(s)):
                if i + 6 <= len(s):
                    if s[i : i + 6] in seen:
                        want.append(at + i)
                    seen.add(s[i : i + 6])
            at += len(s)
        assert repeats.repeated_windows(segments, 6).tolist() == want


def test_runs_own_every_window_once():
    rng = np.random.default_rng(1)
    rows = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in (0, 99, 100, 101, 700, 5, 330)] + [b"q" * 400]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    first, windows, hashes = repeats.owned_runs(data, offsets)
    got = sorted(p for f, w in zip(first, windows, strict=True) for p in range(f, f + w))
    assert got == [o + i for o, r in zip(offsets, rows, strict=False) for i in range(len(r) - L + 1)]
    owner = {data[p : p + L].tobytes(): h for f, w, h in zip(first, windows, hashes, strict=True) for p in range(f, f + w)}
    again = repeats.owned_runs(*[(lambda x: x)(y) for y in (np.concatenate([data[offsets[4] : offsets[5]][7:]]), np.array([0, 693]))])
    for f, w, h in zip(*again, strict=True):
        for p in range(f, f + w):
            assert owner[data[offsets[4] + 7 + p : offsets[4] + 7 + p + L].tobytes()] == h


def results(df, **args):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, **args).collect()}


def test_query_against_sets(spark, monkeypatch):
    docs = corpus()
    want = plain([(i, t.encode()) for i, t in docs])
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(108, None, None, None)], "doc_id long, text string, sha string, row int").repartition(3)
    want[108] = (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert results(df) == want
    assert results(df, hot_segments=2) == want


def test_marks_in_portions(monkeypatch):
    """Anchors that come in portions give the marks that sets give."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    base = rng.integers(97, 123, 400).astype(np.uint8).tobytes()
    rows = []
    for k in range(300):
        a, w = int(rng.integers(0, 200)), int(rng.integers(1, 60))
        rows.append((k // 3, 0, 0, k // 3, 1000 * (k % 3), base[a : a + w + L - 1], w, int(a // 40)))
    rows.sort(key=lambda r: (r[7], repeats.corpus_order(r)))
    want = set()
    for anchor in {r[7] for r in rows}:
        seen = set()
        for r in (x for x in rows if x[7] == anchor):
            for i in range(r[6]):
                if r[5][i : i + L] in seen:
                    want.add((anchor, r[2], r[3], r[4] + i))
                seen.add(r[5][i : i + L])
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(),) * 5 + (pa.binary(), pa.int64(), pa.int64()))], [*"abcdefgh"])
    for size in (200, 3_000, 1 << 20):
        monkeypatch.setattr(repeats, "INDEX_BYTES", size)
        got = set()
        for anchor in {r[7] for r in rows}:  # one at a time: here equal windows may lie at several anchors
            own = batch.filter(pa.array([r[7] == anchor for r in rows]))
            for part in repeats._marked(iter([own.slice(0, 20), own.slice(20)])):
                for block, row, start, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    got |= {(anchor, block, row, start + i) for i in range(n)}
        assert got == want, size


def test_split_segments_keep_equal_windows_together():
    rng = np.random.default_rng(7)
    shared = rng.integers(97, 123, 200).astype(np.uint8).tobytes()
    parts = []
    for k in range(40):
        text = rng.integers(97, 123, 60).astype(np.uint8).tobytes() + shared[int(rng.integers(0, 60)) : 200 - int(rng.integers(0, 60))] + rng.integers(97, 123, 60).astype(np.uint8).tobytes()
        data = np.frombuffer(text, np.uint8)
        for f, w, h in zip(*repeats.owned_runs(data, np.array([0, len(data)])), strict=True):
            parts.append((int(h.view(np.int64)), int(f), int(w), text[f : f + w + L - 1], None, None, k, text))
    for _ in range(8):
        places, keys = [], {}
        for anchor, start, windows, segment, low, high, k, text in parts:
            assert segment == text[start : start + windows + L - 1]
            for i in range(windows):
                places.append((k, start + i))
                keys.setdefault(segment[i : i + L], set()).add((anchor, None if low is None else low - i))
        assert all(len(x) == 1 for x in keys.values())  # equal windows: one anchor, one place in it
        assert len(places) == len(set(places)) == sum(len(t) - L + 1 for t in {p[6]: p[7] for p in parts}.values())
        parts = [(*x, p[6], p[7]) for p in parts for x in repeats.split_segment(*p[:6])]
    assert all(high - low == L for _, _, _, _, low, high, _, _ in parts)


def test_a_text_longer_than_a_piece_and_a_block(spark):
    rng = np.random.default_rng(9)
    body = rng.integers(97, 123, 4_600_000).astype(np.uint8)
    at = 4_400_000
    body[at : at + 300] = body[1_048_400 : 1_048_700]  # across the edge of a piece
    body[2_097_000:2_097_500] = body[10:510]
    docs = [(5, body.tobytes().decode()), (7, body[3_000_000:3_000_400].tobytes().decode() + "!"), (9, "z" * 1000), (2, body[500_000:500_150].tobytes().decode())]
    got = results(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == plain([(i, t.encode()) for i, t in docs])


def test_small_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 150)
    rng = np.random.default_rng(2)
    rows = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 99, 100, 700, 330)]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = []
    for own, begins, buffer, ends in repeats.pieces(data, offsets):
        first, windows, _ = repeats.owned_runs(buffer, ends)
        for f, w in zip(first, windows, strict=True):
            p = np.searchsorted(ends, f, "right") - 1
            got += [(int(own[p]), int(begins[p] + f - ends[p] + i)) for i in range(w)]
    assert sorted(got) == [(r, i) for r, t in enumerate(rows) for i in range(len(t) - L + 1)]


def test_odd_rows(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "n" * 50 + "m" * 120), (4, "n" * 50 + "m" * 120), (4, "n" * 50 + "m" * 120), (4, "other " * 60), (9, "n" * 50 + "m" * 120)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g for g in got if g[0] != "4"] == [("9", 170, 170), ("None", 170, 170)]
    assert [g[1] for g in got if g[0] == "4"] == [170, 170, 360] and got[0][2] == got[1][2]


def test_blocks_lie_in_their_task_s_bucket(spark):
    from pyspark.sql import functions as F

    numbers = [0, 1, -1, 5 << 32, (7 << 32) + 12345, -(1 << 40) - 3]
    df = spark.createDataFrame([(x,) for x in numbers], "block long")
    for n in (1, 4, 97, 5000):
        assert [r.b for r in df.select(F.expr(f"pmod(hash(block), {n})").alias("b")).collect()] == repeats.bucket_of(np.array(numbers), n).tolist()
    own = {t: [x for _, x in zip(range(300), repeats.own_blocks(t, 4), strict=False)] for t in (0, 1, 6)}
    assert len({x for v in own.values() for x in v}) == 900 and all((repeats.bucket_of(np.array(v), 4) == t % 4).all() for t, v in own.items())


def test_texts_are_shuffled_once_and_nothing_is_left_behind(spark, monkeypatch):
    plans, real = {}, repeats.written

    def seen(df, name, *args):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *args)

    monkeypatch.setattr(repeats, "written", seen)
    results(spark.createDataFrame(corpus(), "doc_id long, text string"))
    for name in ("segments", "kept"):
        assert plans[name].count("Exchange hashpartitioning(block") == 1  # of the anchors or the marks
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pipehat_blocks")]


def test_a_failure_leaves_no_table(spark, monkeypatch):
    monkeypatch.setattr(repeats, "cooled", lambda *_: 1 / 0)
    try:
        repeats.without_repeats(spark.createDataFrame(corpus(), "doc_id long, text string"))
    except ZeroDivisionError:
        pass
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pipehat_blocks")]

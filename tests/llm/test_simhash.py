import numpy as np
import xxhash

from pipehat.llm import simhash


def plain_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({x: " " for x in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict[int, int]) -> dict[int, int]:
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint():
    for text in ["", " \t", "One", "one two", "A b C d a b c d", "Été ÉTÉ été x y z", "word " * 700 + "end of it"]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text), text


def test_close_lanes_and_links():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    fps[70:90] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64))
    for shift in (1, 63, 64, 70, 85, 149):
        live = simhash._lanes(np.arange(150) < 150 - shift)
        want = [i for i in range(150 - shift) if bin(int(fps[i] ^ fps[i + shift])).count("1") <= 2]
        assert simhash.close_lanes(simhash.planes_of(fps), shift, live).tolist() == want
    pairs = simhash.bucket_links(np.zeros(150, int), fps)
    assert len(pairs) == 20 and all(bin(int(fps[i] ^ fps[j])).count("1") <= 2 for i, j in pairs)


def test_masks_lose_no_pair():
    roots, split = simhash.masks()
    assert len(roots) == 6 and all(bin(m & (1 << 64) - 1).count("1") == 32 for m in roots)
    for _ in range(2):
        for m, below in split.items():
            free = [p for p in range(64) if not m >> p & 1]
            for p in free:
                for q in free:
                    assert any(not (x >> p & 1 or x >> q & 1) for x in below)


def check(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, mask int")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None}
    fps = {r[0]: plain_fingerprint(r[1] or "") for r in rows if r[0] is not None}
    assert got == {i: (fps[i], c) for i, c in plain_components(fps).items()}


def test_query_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(12)]
    rows = [(100 + i, t, "clash", 1) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split(" ")
        for k in range(5):
            words[(7 * k + i) % 60] = f"new{k}"
            rows.append((1000 + 10 * i + k, " ".join(words), None, None))
    rows += [(5, "", "x", 0), (3, None, None, 0), (8, "  \n", None, 0), (9, base[0].upper(), None, 0), (2, "a", None, 0), (1, "a b", None, 0), (50, "x" * 100_000, None, 0)]
    check(spark, rows)
    monkeypatch.setattr(simhash, "HOT_BUCKET", 1)
    hot = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d: hot(d, 1))
    check(spark, rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect()) == [("4", 4), ("4", 4), ("None", 4)]


def test_components_of_a_chain(spark):
    from pipehat.llm.components import components

    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}

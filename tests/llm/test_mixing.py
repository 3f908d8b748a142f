import hashlib
import re

import duckdb
import numpy as np

from pipehat.llm import mixing

SF = "/root/testdata/sf0.001"


def plain(rows):
    """The fit by loops over a dict of cells."""
    def topic(t, n):
        return next((k for k, m in mixing.TOPICS if m in t), "brief" if n < mixing.BRIEF_TOKENS else "general")

    described = []
    for i, text, source, lang in rows:
        text = text or ""
        n = len(re.findall(r"[^ \t\n\r\f\x0b]+", text))
        described.append((i, source or mixing.NONE, lang or mixing.NONE, topic(text, n), n))
    cells = {}
    for _, *cell, n in described:
        cells[tuple(cell)] = cells.get(tuple(cell), 0) + n
    whole, weight = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    wanted = []
    for k, d in enumerate(mixing.DIMENSIONS):
        sums = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        p = {v: n ** mixing.TEMPERS[d] for v, n in sums.items() if n}
        wanted.append({v: x / sum(p.values()) for v, x in p.items()})
    for _ in range(mixing.MOST_SWEEPS):
        for k in range(3):
            sums = {}
            for c, w in weight.items():
                sums[c[k]] = sums.get(c[k], 0) + w
            weight = {c: w * wanted[k].get(c[k], 0) * whole / sums[c[k]] if sums[c[k]] else 0.0 for c, w in weight.items()}
    out = []
    for i, *cell, n in described:
        c = tuple(cell)
        p = min(1, weight[c] * mixing.RATE / cells[c]) if cells[c] else 0.0
        u = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 if i is not None else 0
        out.append((i, *c, n, p, u < p))
    return out, weight, wanted


def test_against_loops_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    want, weight, wanted = plain(rows)
    got = {r.doc_id: r for r in mixing.op3_mixing(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, s, la, t, n, p, sampled in want:
        r = got[i]
        assert (r.source, r.lang, r.topic, r.n_tokens, r.sampled) == (s, la, t, n, sampled) and abs(r.probability - p) < 2e-6
    whole = sum(weight.values())
    for k, goal in enumerate(wanted):
        for v, share in goal.items():
            assert abs(sum(w for c, w in weight.items() if c[k] == v) / whole - share) < 0.02
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = {r[0]: r for r in con.execute(mixing.OP3_SQL).fetchall()}
    assert all(tuple(got[i]) == r for i, r in sql.items()) and len(sql) == len(got)


def test_odd_rows(spark):
    rows = [(None, "a b", "s", "en", 1.0), (1, None, "s", "en", 2.0), (2, "", None, None, 3.0), (3, "x " * 5000, "t", None, 1.0), (3, "x " * 5000, "t", None, 1.0), (4, "y", "empty", "fr", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight double")
    got = mixing.mixed(df).collect()
    want = {str(x[:5]): x for x in plain([r[:4] for r in rows])[0]}
    assert len(got) == 6
    for r in got:
        w = want[str((r.doc_id, r.mix_source, r.mix_lang, r.mix_topic, r.mix_tokens))]
        assert abs(r.probability - w[5]) < 2e-6 and r.sampled == w[6]
    assert mixing.mixed(df.limit(0)).collect() == []
    none = mixing.mixed(df.where("text is null or text = ''")).collect()
    assert len(none) == 2 and not any(r.sampled for r in none)


def test_expected_tokens_match_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(100, 300)), f"s{min(3, rng.geometric(0.5))}", "en" if rng.random() < 0.8 else "de") for i in range(400)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    whole = sum(r.mix_tokens for r in got)
    shares = {}
    for r in got:
        shares[r.mix_source] = shares.get(r.mix_source, 0) + r.mix_tokens * r.probability * r.weight / (whole * mixing.RATE)
    wanted = plain(rows)[2][0]
    assert all(abs(shares[v] - x) < 0.01 for v, x in wanted.items())


def test_given_targets_and_topics(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 300)), f"s{rng.integers(4)}", "en" if rng.random() < 0.7 else None, f"t{rng.integers(3)}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    targets = [("source", "s0", 0.5), ("source", "s1", 0.1), ("lang", None, 0.6), ("topic", "t2", 0.25), ("topic", "t2", 0.25), ("topic", "nowhere", 0.3)]
    table = spark.createDataFrame(targets, "dimension string, value string, share double")
    cells = mixing.raked_cells(mixing.described(df, "subject"), targets=table)
    report = {(r.dimension, r.value): r for r in mixing.margins(cells).collect()}
    whole = sum(r.weight for k, r in report.items() if k[0] == "source")
    assert max(r.error for r in report.values()) <= mixing.TOLERANCE
    share = {k: r.weight / whole for k, r in report.items()}
    assert abs(share["source", "s0"] - 0.5) < 1e-9 and abs(share["source", "s1"] - 0.1) < 1e-9 and abs(share["source", "s2"] + share["source", "s3"] - 0.4) < 1e-9
    assert abs(share["lang", mixing.NONE] - 0.6) < 1e-9 and abs(share["topic", "t2"] - 0.5) < 1e-9
    # targets that can't all be met end in a report, not in an endless loop
    odd = spark.createDataFrame([(1, "a b c", "x", "en"), (2, "d e f", "y", "de")], "doc_id long, text string, source string, lang string")
    against = spark.createDataFrame([("source", "x", 0.9), ("source", "y", 0.1), ("lang", "en", 0.2), ("lang", "de", 0.8)], "dimension string, value string, share double")
    cells = mixing.raked_cells(mixing.described(odd), targets=against)
    assert mixing.margins(cells).agg({"error": "max"}).first()[0] > 0.1


def test_clashing_columns(spark):
    rows = [(i, "w " * (i + 1), f"s{i % 3}", "en", f"own{i}", f"kept{i}", "old", 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, cell_source string, cell__lang string, mix_topic string, share double")
    got = mixing.mixed(df)
    assert sorted(got.columns) == sorted([*df.columns, "mix_tokens", "mix_source", "mix_lang", "probability", "weight", "sampled"])
    assert {(r.doc_id, r.cell_source, r.cell__lang, r.share) for r in got.collect()} == {(r[0], r[4], r[5], r[7]) for r in rows} and all(r.mix_topic == "brief" for r in got.collect())

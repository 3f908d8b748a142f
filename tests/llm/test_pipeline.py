import corpus_pipeline as cp
from pipehat.llm import decontaminate, pii, quality
from tests.llm.test_simhash_sets import plain_components

SF = "/root/testdata/sf0.001"
KEYS = ["quality", "near_duplicates", "leaks", "personal_data", "mixture"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == KEYS and 4 <= len(cp.STAGES) <= 5
    stage = dict(cp.STAGES)
    toxic = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    good = cp.written(stage["quality"](spark, docs, SF), "good")
    assert tuple(good.columns) == cp.COLUMNS
    scores = {r.doc_id: r.predicted for r in quality.op4_quality(spark, SF).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p == 1}
    clean = [i for i, (q, _) in toxic.items() if q == 1]
    assert sum(scores[i] for i in clean) >= 0.97 * len(clean)

    one = cp.written(stage["near_duplicates"](spark, good, SF), "one")
    groups = plain_components({r.doc_id: r.text for r in good.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values())) and tuple(one.columns) == cp.COLUMNS

    left = cp.written(stage["leaks"](spark, one, SF), "left")
    bad = {r.doc_id for r in decontaminate.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in left.collect()} == set(groups.values()) - bad

    safe = cp.written(stage["personal_data"](spark, left, SF), "safe")
    before, after = {r.doc_id: r.text for r in left.collect()}, {r.doc_id: r for r in safe.collect()}
    assert set(before) == set(after) and all(len(r.text) == r.n_chars for r in after.values())
    assert not any(pii.base_spans(r.text) for r in after.values()) and all(after[i].text == t for i, t in before.items() if not pii.found_spans([t], *pii.model())[0][1])

    last = stage["mixture"](spark, safe, SF)
    assert 0 < last.count() <= len(after) and all(0 < r.probability <= 1 and r.weight > 0.999 for r in last.collect())


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, "some plain words", "en", "s", 16, 0.0), (1, "some plain words", "en", "s", 16, 0.0), (None, "words and more words", None, None, None, None), (None, None, None, None, None, None), (4, "", "en", "s", 0, 0.0), (5, "x " * 60_000, "en", "s", 120_000, 1.0)]
    docs = spark.createDataFrame(rows, schema)
    docs.drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, f in cp.STAGES:
        assert set(cp.COLUMNS) <= set(f(spark, docs, str(tmp_path)).columns)
        f(spark, docs, str(tmp_path)).collect()
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == []
    kept = dict(cp.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "None", "None"]


def test_run(spark):
    assert cp.run(spark, SF).count() > 0

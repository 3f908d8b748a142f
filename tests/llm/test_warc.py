import gzip
import hashlib
import json

import pytest
from pyarrow import fs

from pipehat.llm import warc
from pipehat.llm.common import shared_dir

PAGES = [
    (5, "http://a/5", "x" * 100), (3, "http://a/3", "x" * 100), (9, None, "x" * 100), (1, "u\r\nv", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
    (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (8, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (None, "u", "y" * 200), (None, "u", "y" * 200), (11, "u", "z" * 300_000), (11, "u", "z" * 300_000),
]


def test_records_of_any_pieces():
    made = [warc.record("response", [("WARC-Record-ID", "<urn:page:1>")], b"a\r\n\r\nb" * k) for k in (0, 1, 500)]
    for stream in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))):
        for step in (1, 7, len(stream)):
            assert list(warc.records(iter([stream[i : i + step] for i in range(0, len(stream), step)]))) == made
    with pytest.raises(ValueError):
        list(warc.records(iter([gzip.compress(b"".join(made)[:-9])])))
    with pytest.raises(ValueError):
        list(warc.records(iter([gzip.compress(b"".join(made))[:-9]])))


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in PAGES], "page_id long, url string, html string, archive string").repartition(2)
    index = warc.archived(df, f"file://{tmp_path}/out")
    got = warc.read_records(index, f"file://{tmp_path}/out").collect()
    key = lambda x: tuple((v is None, v) for v in x)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        ids = [p[0] for p in PAGES if (p[2] or "") == (h or "") and p[0] is not None]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if len(raw) < 100 or i == min(ids, default=None) else "revisit", min(ids, default=None) if len(raw) >= 100 and i != min(ids, default=None) else None))
    want = [w if w[0] != 11 else (*w[:3], "response", None) for w in want]
    for again in ((11, "revisit", 11), (None, "revisit", None)):  # of equal ids, one is the response
        k = next(j for j, w in enumerate(want) if w[0] == again[0])
        want[k] = (*want[k][:3], again[1], again[2])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload) in [(h or "").encode() for i, _, h in PAGES if i == r.page_id] for r in got if r.record_type == "response")
    local = fs.LocalFileSystem()
    for f in local.get_file_info(fs.FileSelector(f"{tmp_path}/out")):
        if f.path.endswith(".jsonl"):
            whole = open(f.path.removesuffix(".index.jsonl"), "rb").read()
            lines = [json.loads(x) for x in open(f.path)]
            assert sum(x["length"] for x in lines) == len(whole) and len(lines) <= 3
            for x in lines:
                headers, _ = warc.parsed(gzip.decompress(whole[x["offset"] : x["offset"] + x["length"]]))
                assert headers["warc-type"] == x["record_type"]
            assert b"".join(warc.records(iter([whole]))) == gzip.decompress(whole)


def test_empty(spark, tmp_path):
    index = warc.archived(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/out")
    assert warc.read_records(index, f"file://{tmp_path}/out").collect() == []
    assert shared_dir(spark)

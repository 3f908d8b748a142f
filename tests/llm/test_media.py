import gzip
import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

from pipehat.llm import media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(6))) + chunk(b"IEND", b"")


def remainder(data, polynomial, bits):
    x = 0
    for byte in data:
        x ^= byte << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> (bits - 1) else x << 1) & ((1 << bits) - 1)
    return x


def ogg_page(flags):
    page = b"OggS\0" + bytes([flags]) + bytes(16) + bytes(4) + b"\x01\x05hello"
    return page[:22] + struct.pack("<I", remainder(page, 0x04C11DB7, 32)) + page[26:]


def flac(frames=3, known=True):
    total = 192 * frames if known else 0
    out = b"fLaC\x80\0\0\x22" + bytes(10) + struct.pack(">Q", 44100 << 44 | 15 << 36 | total) + bytes(16)
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, k])
        body = head + bytes([remainder(head, 7, 8)]) + b"\0\x12" + bytes([k])
        out += body + struct.pack(">H", remainder(body, 0x8005, 16))
    return out


def samples():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    return {
        "image/png": png(),
        "image/gif": b"GIF89a\x01\0\x01\0\x80\0\0" + bytes(6) + b"!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;",
        "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x03x" + b"data\xff\0more" + b"\xff\xd9",
        "audio/wav": media.wav(bytes(range(128))),
        "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF",
        "application/zip": packed.getvalue(),
        "application/gzip": gzip.compress(b"some text" * 20, mtime=0),
        "audio/ogg": ogg_page(2) + ogg_page(4),
        "audio/flac": flac(),
        "image/bmp": b"BM" + struct.pack("<IIIIiiHH", 60, 0, 54, 40, 1, 1, 1, 24) + bytes(24) + bytes(6),
        "video/mp4": b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cmoovabcd",
        "audio/midi": b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk\0\0\0\x04\0\xff\x2f\0",
    }


def test_types_lengths_and_carving():
    magics = media.automaton()
    for kind, content in samples().items():
        assert media.sniff(content, magics) == media.Sniffed(kind, len(content)), kind
        inside = b"some words BM RIFF PK\x03\x04 " + content
        found = media.sniff(inside + b"!!", magics)
        assert found.media_type == media.UNKNOWN and found.embedded == [(kind, len(inside) - len(content), len(content))], kind
        assert media.sniff(content[:-1], magics).media_type == media.UNKNOWN, kind
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken), magics).media_type == media.UNKNOWN


def test_ends_of_files_among_others():
    magics = media.automaton()
    once = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    updated = once + b"\n2 0 obj\nstartxref\n30\n%%EOF"
    outer, inner = io.BytesIO(), samples()["application/zip"]
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner)
        z.writestr("b", "more")
    parts = [flac(), png(), updated, outer.getvalue(), once, flac(2, known=False), samples()["image/jpeg"], ogg_page(2) + ogg_page(4), png()]
    content, want = b"start", []
    for part in parts:
        want.append((len(content), len(part)))
        content += part
    assert [(s, n) for _, s, n in media.sniff(content, magics).embedded] == want
    broken = bytearray(flac())
    broken[-3] ^= 1
    assert media.sniff(bytes(broken), magics).media_type == media.UNKNOWN
    page = bytearray(ogg_page(2) + ogg_page(4))
    page[30] ^= 1
    assert media.sniff(bytes(page), magics).media_type == media.UNKNOWN


def test_many_hits_take_linear_time():
    magics = media.automaton()
    for mark in (b"PK\x03\x04", b"%PDF-1.4", b"%PDF-1.4startxref 1 %%EOF"[:8] + b" x", b"\xff\xd8\xff\xda\0\x03x", b"PK\x05\x06" + bytes(18)):
        began = time.process_time()
        media.sniff(mark * 40_000, magics)
        assert time.process_time() - began < 6, mark


def test_random_bytes_do_not_crash():
    magics, rng = media.automaton(), random.Random(5)
    for _ in range(400):
        content = b"".join(rng.choice([*media.SIGNATURES, rng.randbytes(9), bytes(5)]) for _ in range(20))
        media.sniff(content, magics)


def test_sniffed_frame(spark):
    rows = [(1, png(), "text/plain", 0), (2, None, None, 0), (3, b"plain", "text/plain", 0), (4, b"xx" + png() + b"yy", "a/b", 0), (4, b"", "a/b", 0)]
    got = media.sniffed(spark.createDataFrame(rows, "id int, cell binary, kind string, carved int"), "id", "cell", "kind").collect()
    assert [(r.id, r.media_type, r.corrected, len(r.embedded)) for r in got] == [(1, "image/png", True, 0), (2, media.UNKNOWN, False, 0), (3, "text/plain", False, 0), (4, "a/b", False, 1), (4, "a/b", False, 0)]
    assert bytes(got[3].carved[0]) == png()


def plain_reading(cell):
    """(type, samples, [(type, start, bytes) of what is embedded]) of a stored cell, by other readers than the operator's."""
    if cell[:4] == b"RIFF":
        with wave.open(io.BytesIO(cell)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            at = cell.index(b"\x89PNG")
            return "audio/wav", w.readframes(w.getnframes()), [("image/png", at, cell[at : cell.index(b"IEND") + 8])]
    at = 33
    assert cell[at + 4 : at + 8] == b"IDAT"
    n, width = struct.unpack(">I", cell[at : at + 4])[0], struct.unpack(">I", cell[16:20])[0]
    raw, end = zlib.decompress(cell[at + 8 : at + 8 + n]), at + 12 + n + 12
    rows = [raw[k : k + width + 1] for k in range(0, len(raw), width + 1)]
    assert all(x[0] == 0 for x in rows)
    with wave.open(io.BytesIO(cell[end:])) as w:
        assert w.readframes(w.getnframes()) == b"".join(x[1:] for x in rows)[-64:]
    return "image/png", b"".join(x[1:] for x in rows), [("audio/wav", end, cell[end:])]


def test_table_against_other_readers(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op9_media(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    corrected = set()
    for r in got:
        payload = media.padded(texts[r.doc_id])
        cell, declared = media.stored(payload)
        real, read, inner = plain_reading(cell)
        assert read == payload and r.media_sha256 == hashlib.sha256(cell).hexdigest() and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        want = ",".join(f"{k}@{s}+{len(x)}:{zlib.crc32(x):08x}" for k, s, x in inner)
        crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:], strict=False))
        assert r.feature == f"{real};corrected={int(real != declared)};samples={len(payload)};sum={sum(payload)};crossings={crossings};embedded={want}"
        corrected.add((real, real != declared))
    assert len(corrected) == 4


def test_stored_texts(spark):
    rows = [(1, "é" * 40), (2, ""), (3, None), (None, "x" * 64), (5, "x" * 65), (5, "x" * 65), (6, "BM RIFF \0" * 50_000)]
    got = media.stored_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        cell, declared = media.stored(payload)
        assert (r.media_bytes, r.media_sha256) == (len(cell), hashlib.sha256(cell).hexdigest())
        real, read, inner = plain_reading(cell)
        assert read == payload and r.feature.startswith(f"{real};corrected={int(real != declared)};samples={len(payload)};sum={sum(payload)};")
        for kind, start, part in inner:
            assert f"{kind}@{start}+{len(part)}:{zlib.crc32(part):08x}" in r.feature
        if i != 6:
            assert r.feature.count("@") == 1
    assert got[1].feature == got[2].feature and got[4] == got[5]
    assert media.stored_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []

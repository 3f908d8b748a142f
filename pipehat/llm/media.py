"""Media columns: find out what binary cells really hold, and carve media embedded in them.

An Aho-Corasick automaton finds every magic byte string in one pass. Each hit goes to the
validator of its format, which walks the structure (chunk lengths, checksums, box sizes, trailers)
and gives the length of the file that starts there, or nothing. A valid file at the first byte
corrects the declared type; valid files further in are carved.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, documents, texts

UNKNOWN = "application/octet-stream"
UNIT = 64
BLOCK_BYTES = 8 << 20


class Cell:
    """The bytes of a cell, and what is looked for once in all of it."""

    def __init__(self, content: bytes):
        self.content = content
        self.view = memoryview(content)

    def __len__(self) -> int:
        return len(self.content)

    def __getitem__(self, at):
        return self.view[at]

    def places(self, mark: bytes) -> list[int]:
        out, k = [], self.content.find(mark)
        while k >= 0:
            out.append(k)
            k = self.content.find(mark, k + 1)
        return out

    @functools.cached_property
    def pdf_starts(self) -> list[int]:
        return self.places(b"%PDF-")

    @functools.cached_property
    def pdf_ends(self) -> list[int]:
        """Ends of the trailers: a cross-reference offset and the end mark."""
        return [m.end() for m in re.finditer(rb"startxref\s{1,8}[0-9]{1,20}\s{1,8}%%EOF", self.content)]

    @functools.cached_property
    def zips(self) -> dict[int, int]:
        """The end of each archive by its start, as the end records give them."""
        out: dict[int, int] = {}
        for k in self.places(b"PK\x05\x06"):
            if k + 22 > len(self.content):
                continue
            size, offset, note = struct.unpack("<IIH", self.content[k + 12 : k + 22])
            start, end = k - size - offset, k + 22 + note
            if start >= 0 and end <= len(self.content) and (not size or self.content[start + offset : start + offset + 4] == b"PK\x01\x02"):
                out.setdefault(start, end)
        return out


def _png(b: Cell, at: int) -> int | None:
    k = at + 8
    while k + 12 <= len(b):
        n = int.from_bytes(b[k : k + 4], "big")
        end = k + 12 + n
        if end > len(b) or (k == at + 8) != (b[k + 4 : k + 8] == b"IHDR") or zlib.crc32(b[k + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if b[k + 4 : k + 8] == b"IEND":
            return end - at
        k = end
    return None


def _gif(b: Cell, at: int) -> int | None:
    table = lambda flags: 3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0

    def blocks(k: int) -> int | None:
        while k < len(b):
            if not b[k]:
                return k + 1
            k += 1 + b[k]
        return None

    if at + 13 > len(b):
        return None
    k: int | None = at + 13 + table(b[at + 10])
    while k is not None and k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 < len(b):
            k = blocks(k + 11 + table(b[k + 9]))
        else:
            return None
    return None


def _jpeg(b: Cell, at: int) -> int | None:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        marker = b[k + 1]
        if marker == 0xD9:
            return k + 2 - at
        n = int.from_bytes(b[k + 2 : k + 4], "big")
        if n < 2 or not 0xC0 <= marker <= 0xFE:
            return None
        k += 2 + n
        if marker == 0xDA:  # entropy-coded data up to the next real marker
            k = b.content.find(b"\xff", k)
            while 0 <= k < len(b) - 1 and (b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k = b.content.find(b"\xff", k + 2)
            if k < 0:
                return None
    return k + 2 - at if b[k : k + 2] == b"\xff\xd9" else None


def _riff(b: Cell, at: int) -> int | None:
    if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) not in RIFF_FORMS:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    k = at + 12
    while k + 8 <= min(end, len(b)):
        k += 8 + (n := int.from_bytes(b[k + 4 : k + 8], "little")) + n % 2
    return end - at if k == end <= len(b) else None


def _pdf(b: Cell, at: int) -> int | None:
    """Up to the last trailer before the next file: an updated file has one for each update."""
    if at + 8 > len(b) or not (48 <= b[at + 5] < 58 and b[at + 6] == 46 and 48 <= b[at + 7] < 58):
        return None
    following = bisect.bisect_right(b.pdf_starts, at)
    stop = b.pdf_starts[following] if following < len(b.pdf_starts) else len(b)
    k = bisect.bisect_right(b.pdf_ends, stop) - 1
    return b.pdf_ends[k] - at if k >= 0 and b.pdf_ends[k] > at else None


def _zip(b: Cell, at: int) -> int | None:
    return b.zips[at] - at if at in b.zips else None


def _gzip(b: Cell, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        k = at
        while not inflate.eof and k < len(b):
            inflate.decompress(b[k : k + 65536])
            k += 65536
    except zlib.error:
        return None
    return min(k, len(b)) - len(inflate.unused_data) - at if inflate.eof else None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    """The remainders of all bytes by a polynomial, highest bit first."""
    out, top = [], 1 << (bits - 1)
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ polynomial if x & top else x << 1) & ((1 << bits) - 1)
        out.append(x)
    return out


_CRC8, _CRC16, _CRC32 = _crc_table(0x07, 8), _crc_table(0x8005, 16), _crc_table(0x04C11DB7, 32)


def _ogg(b: Cell, at: int) -> int | None:
    k, last = at, False
    while not last and k + 27 <= len(b) and b[k : k + 4] == b"OggS" and b[k + 4] == 0:
        last, n = bool(b[k + 5] & 4), b[k + 26]
        end = k + 27 + n + sum(b[k + 27 : k + 27 + n])
        if end > len(b):
            return None
        crc = 0
        for x in b.content[k : k + 22] + bytes(4) + b.content[k + 26 : end]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC32[crc >> 24 ^ x]
        if crc != int.from_bytes(b[k + 22 : k + 26], "little"):
            return None
        k = end
    return k - at if last else None


def _flac_header(b: Cell, k: int) -> tuple[int, int] | None:
    """(bytes, samples) of the frame header at ``k``, if there is one."""
    if k + 6 > len(b) or b[k] != 0xFF or b[k + 1] & 0xFE != 0xF8 or not b[k + 2] >> 4 or b[k + 2] & 15 == 15 or b[k + 3] >> 4 > 10 or b[k + 3] & 1:
        return None
    first, n = b[k + 4], 0
    while n < 7 and first & (0x80 >> n):  # the frame's number, coded like a character
        n += 1
    if n == 1 or n > 7:
        return None
    at, size, rate = k + 4 + max(n, 1), b[k + 2] >> 4, b[k + 2] & 15
    wide = {6: 1, 7: 2}.get(size, 0)
    own = at + wide
    end = own + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(b):
        return None
    crc = 0
    for x in b[k:end]:
        crc = _CRC8[crc ^ x]
    samples = int.from_bytes(b[at:own], "big") + 1 if wide else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    return (end + 1 - k, samples) if crc == b[end] else None


def _flac(b: Cell, at: int) -> int | None:
    """The metadata, and frames with sound checksums up to the number of samples that the metadata gives (or, if it gives none, as long as they go on)."""
    if at + 42 > len(b) or b[at + 4] & 127 or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return None
    total = int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
    k, last = at + 4, False
    while not last and k + 4 <= len(b):
        last = bool(b[k] & 128)
        k += 4 + int.from_bytes(b[k + 1 : k + 4], "big")
    if not last or k > len(b):
        return None
    done = 0
    while (not total or done < total) and (head := _flac_header(b, k)) is not None:
        done += head[1]
        crc, e, end, first = 0, k, None, None
        whole = bool(total) and done >= total
        while e < len(b) and end is None:
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[e]]
            e += 1
            # a remainder of 0 ends a frame if another frame or nothing follows, or all samples are there
            if not crc and e - k > head[0] + 2:
                first = first or e
                end = e if whole or e == len(b) or _flac_header(b, e) is not None else None
        if end is None and (total or first is None):
            return None
        k = end or first
        if end is None:  # of an unknown number of frames, the last
            break
    return k - at if done >= total else None


def _bmp(b: Cell, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, reserved, offset, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes, depth = struct.unpack("<HH", b[at + 26 : at + 30])
    fits = not reserved and header in BMP_HEADERS and planes == 1 and depth in BMP_DEPTHS and 14 + header <= offset < size
    return size if fits and at + size <= len(b) else None


def _mp4(b: Cell, at: int) -> int | None:
    at -= 4
    k, seen = at, set()
    while at >= 0 and k + 8 <= len(b) and (kind := bytes(b[k + 4 : k + 8])) in MP4_BOXES:
        n = int.from_bytes(b[k : k + 4], "big")
        if n < 8 or k + n > len(b):
            break
        seen.add(kind)
        k += n
    return k - at if b"moov" in seen else None


def _midi(b: Cell, at: int) -> int | None:
    if at + 14 > len(b) or int.from_bytes(b[at + 4 : at + 8], "big") != 6:
        return None
    k = at + 14
    for _ in range(int.from_bytes(b[at + 10 : at + 12], "big")):
        if b[k : k + 4] != b"MTrk" or k + 8 > len(b):
            return None
        k += 8 + int.from_bytes(b[k + 4 : k + 8], "big")
    return k - at if k <= len(b) else None


# Fixed values of the formats.
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}
BMP_HEADERS = (12, 40, 52, 56, 64, 108, 124)
BMP_DEPTHS = (1, 4, 8, 16, 24, 32)
MP4_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"mfra", b"sidx", b"styp", b"meta")
SIGNATURES: dict[bytes, tuple[str, Callable[[Cell, int], int | None]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"RIFF": ("", _riff),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"OggS\x00\x02": ("audio/ogg", _ogg),
    b"fLaC": ("audio/flac", _flac),
    b"BM": ("image/bmp", _bmp),
    b"ftyp": ("video/mp4", _mp4),
    b"MThd": ("audio/midi", _midi),
}


@dataclass
class Sniffed:
    """media_type: of the file at the first byte; length: its bytes; embedded: (type, start, length) of files further in."""

    media_type: str
    length: int
    embedded: list[tuple[str, int, int]] = field(default_factory=list)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(content: bytes, magics: ahocorasick.Automaton) -> Sniffed:
    """What ``content`` holds. Carved files don't overlap one another; those within a carved file are left in it."""
    out, cell, past = Sniffed(UNKNOWN, 0), Cell(content), 0
    for last, magic in magics.iter(content.decode("latin-1")):
        at = last + 1 - len(magic)
        media_type, length_of = SIGNATURES[magic]
        start = at - 4 if magic == b"ftyp" else at
        if start < past or (n := length_of(cell, at)) is None:
            continue
        media_type = media_type or RIFF_FORMS[content[at + 8 : at + 12]]
        if start == 0:
            out.media_type, out.length = media_type, n
        else:
            out.embedded.append((media_type, start, n))
            past = start + n
    return out


def sniffed(df: DataFrame, key: str, content: str, declared: str) -> DataFrame:
    """(key, declared_type, media_type, corrected, media_bytes, embedded, carved) for every row of ``df``.

    A null or empty cell is of unknown type with nothing embedded. A cell of no known type keeps its
    declared type; a null declared type counts as unknown. ``carved`` holds the bytes of each embedded file. Where files overlap,
    the one that starts first is carved. Very long cells are a batch of their own, and take time in proportion. Repeated rows and null keys
    keep a row each. Other columns are not read, so they may have any name. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magics = automaton()
        for batch in batches:
            for part in byte_slices(batch, "content", BLOCK_BYTES):
                cells = texts(part.column(1))
                said = [x or UNKNOWN for x in part.column(2).to_pylist()]
                found = [sniff(x, magics) for x in cells]
                real = [f.media_type if f.media_type != UNKNOWN else s for f, s in zip(found, said, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": part.column(0),
                        "declared_type": said,
                        "media_type": real,
                        "corrected": [a != b for a, b in zip(said, real, strict=True)],
                        "media_bytes": pa.array([f.length for f in found], pa.int64()),
                        "embedded": pa.array([[{"media_type": t, "start": s, "length": n} for t, s, n in f.embedded] for f in found], EMBEDDED),
                        "carved": pa.array([[c[s : s + n] for _, s, n in f.embedded] for c, f in zip(cells, found, strict=True)], pa.list_(pa.binary())),
                    }
                )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"), F.col(declared).alias("declared"))
    out = rows.mapInArrow(run, f"key {kind}, declared_type string, media_type string, corrected boolean, media_bytes long, embedded array<struct<media_type:string,start:long,length:long>>, carved array<binary>")
    return out.withColumnRenamed("key", key)


EMBEDDED = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def wav(samples: bytes, rate: int = 8000, more: bytes = b"") -> bytes:
    """8-bit mono PCM in a RIFF file; ``samples`` must be of even length, ``more`` is a chunk before them."""
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH", 36 + len(more) + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + more + struct.pack("<4sI", b"data", len(samples)) + samples


def wav_samples(content: bytes) -> bytes:
    """The sample bytes of a RIFF file, found by walking its chunks."""
    k = 12
    while content[k : k + 4] != b"data":
        n = int.from_bytes(content[k + 4 : k + 8], "little")
        k += 8 + n + n % 2
    return content[k + 8 : k + 8 + int.from_bytes(content[k + 4 : k + 8], "little")]


def png(samples: bytes, width: int = UNIT) -> bytes:
    """8-bit grey in a PNG file, ``width`` samples a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    body = zlib.compress(np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes(), 0)
    part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b"")


def png_samples(content: bytes) -> bytes:
    """The samples of an unfiltered 8-bit grey PNG file."""
    k, body, width = 8, b"", 0
    while (kind := content[k + 4 : k + 8]) != b"IEND":
        n = int.from_bytes(content[k : k + 4], "big")
        if kind == b"IHDR":
            width = int.from_bytes(content[k + 8 : k + 12], "big")
        elif kind == b"IDAT":
            body += content[k + 8 : k + 8 + n]
        k += 12 + n
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, width + 1)[:, 1:]).tobytes()


#: What the stored cells are declared as, by the second byte of the payload's digest; the first byte says what they are.
DECLARED = ("audio/wav", "image/png", "application/pdf", UNKNOWN)
READERS = {"audio/wav": wav_samples, "image/png": png_samples}


def stored(payload: bytes) -> tuple[bytes, str]:
    """A cell that holds ``payload`` as samples, and its declared type, both by the payload's digest.

    It is sound with a preview image of the first samples as a chunk within, or an image with the last samples as sound behind it; the
    declared type is often wrong, as in found data.
    """
    digest = hashlib.sha256(payload).digest()
    if digest[0] % 2:
        preview = png(payload[:UNIT], 8)
        cell = wav(payload, more=b"prev" + struct.pack("<I", len(preview)) + preview + bytes(len(preview) % 2))
    else:
        cell = png(payload) + wav(payload[-UNIT:])
    return cell, DECLARED[digest[1] % len(DECLARED)]


def feature(found: Sniffed, declared: str, samples: bytes, carved: list[bytes]) -> str:
    """The type, whether it was declared otherwise, samples, their sum and sign changes about the middle, and each carved file with its checksum."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    inner = ",".join(f"{t}@{s}+{n}:{zlib.crc32(c):08x}" for (t, s, n), c in zip(found.embedded, carved, strict=True))
    return f"{found.media_type};corrected={int(found.media_type != declared)};samples={len(x)};sum={int(x.sum(dtype=np.int64))};crossings={int((high[1:] != high[:-1]).sum())};embedded={inner}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    magics = automaton()
    for batch in batches:
        for part in byte_slices(batch, "text", BLOCK_BYTES):
            rows = []
            for text in texts(part.column(1)):
                media, declared = stored(padded(text))
                found = sniff(media, magics)  # says how the cell is read, whatever it is declared as
                payload = READERS[found.media_type](media[: found.length])
                carved = [media[s : s + n] for _, s, n in found.embedded]
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found, declared, payload, carved)))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text, zero-padded, as the samples of a media cell of some declared type, sniffed, read back by its real type, and what is embedded carved.

    One row per input row, null ids and repeated rows included; null text counts as empty (64 zero
    bytes of payload). Equal texts give equal values. A text that holds magic bytes may give further carved files; ties don't occur. Very long texts are
    stored whole. Only doc_id and text are read. An empty table gives an empty result.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` through a media cell; see ``stored_texts`` for nulls, empty and very long texts, and repeated rows."""
    return stored_texts(documents(spark, sf_dir, "doc_id", "text"))

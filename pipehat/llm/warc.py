"""WARC archives: whole-file gzip is rewritten so that every record is a gzip member of its own.

``write_archives`` writes pages as archives of one gzip stream each (the form that crawlers' simpler
tools leave behind) and a manifest. ``normalise`` inflates each such stream once, from start to end,
rewrites every record as its own member into a new archive, and writes a side file with the offset
and length of each; records whose payload another record already holds become revisits on the way.
``read_records`` then reads single records by offset.

Archives hold at most ``ARCHIVE_BYTES`` of records (or one that is longer) and ``ARCHIVE_RECORDS``
records, so that a task that holds the revisits of one archive is bounded. Nothing but the manifest
and the index, some dozens of bytes a page, is shuffled; page contents go through files in the shared
folder, with names of their own for each attempt, so a repeated task overwrites nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, delete_path, scratch_path, texts, written

LEAST_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 20_000
READ_BYTES = 1 << 18
MOST_TASKS = 20_000
LEVEL = 5
DATE = "2020-01-01T00:00:00Z"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip stream that comes in pieces, inflated once; several members follow one another."""
    held, inflate, need = bytearray(), zlib.decompressobj(31), None
    begun = False

    def whole() -> Iterator[bytes]:
        nonlocal need
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    return
                fields = dict(x.lower().split(b": ", 1) for x in bytes(held[:end]).split(b"\r\n")[1:] if b": " in x)
                need = end + 4 + int(fields[b"content-length"]) + 4
            if len(held) < need:
                return
            out = bytes(held[:need])
            del held[:need]
            need = None
            yield out

    for chunk in chunks:
        while chunk:
            if inflate.eof:
                inflate, begun = zlib.decompressobj(31), False
            held += inflate.decompress(chunk, READ_BYTES * 16)
            begun = True
            chunk = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            yield from whole()
    if held or begun and not inflate.eof:
        raise ValueError("the archive ends within a record")


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _line(value: str | None) -> str:
    """A header value: line breaks would end the header."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


MANIFEST = "archive string, number long, page_id long, payload_digest string, payload_bytes long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of one gzip stream each in ``folder`` for the rows of ``pages`` (page_id, url, html), and their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(folder)
        store.create_dir(path, recursive=True)
        attempt, count, sink, deflate, size, number = _attempt(), 0, None, None, 0, 0

        def close():
            if sink is not None:
                sink.write(deflate.flush())
                sink.close()

        for batch in batches:
            for part in byte_slices(batch, "html", 4 << 20):
                out = []
                for page_id, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
                    if sink is None or size and size + len(html) > ARCHIVE_BYTES or number >= ARCHIVE_RECORDS:
                        close()
                        name = f"{attempt}-{count:04d}.warc.gz"
                        sink, deflate = store.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        count, size, number = count + 1, 0, 0
                    digest = hashlib.sha256(html).hexdigest()
                    headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Target-URI", _line(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(html))), ("Content-Type", "text/html")]
                    sink.write(deflate.compress(record("response", headers, html)))
                    out.append((name, number, page_id, digest, len(html)))
                    size, number = size + len(html), number + 1
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["archive", "number", "page_id", "payload_digest", "payload_bytes"])
        close()

    return written(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, MANIFEST), "manifest")


def revisits(manifest: DataFrame) -> DataFrame:
    """(archive, number, refers_to) of the records that repeat the payload of another, which has the smallest page_id.

    Null ids come last; of rows with the same smallest id, the first in its archive stays.
    """
    place = F.struct(F.col("page_id").isNull(), "page_id", "archive", "number")
    long = manifest.where(F.col("payload_bytes") >= LEAST_REVISIT)
    first = long.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("payload_digest").alias("digest"), "first")
    found = long.join(first, F.col("payload_digest") == F.col("digest")).where(place != F.col("first"))
    return found.select("archive", "number", F.col("first.page_id").alias("refers_to"))


INDEX = "archive string, page_id long, record_type string, offset long, length long"


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Archives in ``folder`` with a gzip member for every record, and their index.

    ``archives`` has a row (archive, repeats) for each file in ``source``: repeats is a list of (number,
    refers_to) for the records to rewrite as revisits, or null. Beside each archive lies a side file
    ``.index.jsonl`` with a line for every record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, old = _file_system(source)
        there, new = _file_system(folder)
        there.create_dir(new, recursive=True)
        for batch in batches:
            for name, repeats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                again = {x["number"]: x["refers_to"] for x in repeats or ()}
                target, out, offset = f"{_attempt()}-{name}", [], 0
                with here.open_input_stream(f"{old}/{name}", compression=None) as stream, there.open_output_stream(f"{new}/{target}", compression=None) as sink:
                    for number, content in enumerate(records(iter(lambda: stream.read(READ_BYTES), b""))):
                        headers, block = parsed(content)
                        kind = headers["warc-type"]
                        if number in again:
                            kind = "revisit"
                            keep = ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "X-Payload-Length", "Content-Type")
                            content = record(kind, [*((k, headers[k.lower()]) for k in keep), ("WARC-Refers-To", _urn(again[number]))], b"")
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = deflate.compress(content) + deflate.flush()
                        sink.write(member)
                        out.append((target, _page_id(headers["warc-record-id"]), kind, offset, len(member)))
                        offset += len(member)
                lines = "".join(json.dumps({"page_id": i, "record_type": k, "offset": o, "length": n}) + "\n" for _, i, k, o, n in out)
                with there.open_output_stream(f"{new}/{target}.index.jsonl", compression=None) as side:
                    side.write(lines.encode())
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["archive", "page_id", "record_type", "offset", "length"])

    return written(archives.select("archive", "repeats").mapInArrow(run, INDEX), "index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, each read and inflated by itself. A payload that isn't what its header says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(folder)
        name, stream = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                out = []
                for archive, offset, length in zip(*(batch.column(i).slice(k, 512).to_pylist() for i in range(3)), strict=True):
                    if archive != name:
                        if stream is not None:
                            stream.close()
                        name, stream = archive, store.open_input_file(f"{path}/{archive}")
                    headers, block = parsed(zlib.decompress(stream.read_at(length, offset), 31))
                    digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                    kind = headers["warc-type"]
                    if kind == "response" and (size != len(block) or digest != hashlib.sha256(block).hexdigest()):
                        raise ValueError(f"{archive}: the record at {offset} is damaged")
                    refers = _page_id(headers["warc-refers-to"]) if kind == "revisit" else None
                    out.append((_page_id(headers["warc-record-id"]), size, digest, kind, refers, headers["warc-target-uri"], block if payloads else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return index.select("archive", "offset", "length").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """``pages`` (page_id, url, html) written to ``folder`` as normalised archives; returns their index.

    Null html is an empty payload; null ids and urls are written as empty. Repeated rows are records of
    their own, all but one of them revisits; of rows that tie for the smallest id, the first in its archive stays. A very long page is a
    slice of a batch and an archive of its own. Other columns of ``pages`` are not read. An empty table writes nothing.
    """
    spark = pages.sparkSession
    raw = scratch_path(spark, "whole")
    manifest = write_archives(pages, raw)
    repeats = revisits(manifest).groupBy("archive").agg(F.collect_list(F.struct("number", "refers_to")).alias("repeats"))
    names = manifest.select(F.col("archive").alias("name")).distinct()
    archives = names.join(repeats, F.col("name") == F.col("archive"), "left").select(F.col("name").alias("archive"), "repeats")
    tasks = min(max(1, names.count()), MOST_TASKS)  # one archive a task, or several in turn
    index = normalise(archives.repartition(tasks), raw, folder)
    delete_path(spark, raw)
    return index


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every page, written and read back; see ``archived`` for nulls, empty and very long pages, ties and repeated rows."""
    folder = scratch_path(spark, "warc")
    index = archived(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

"""Benchmark decontamination: documents that hold a benchmark item, give or take some edits.

An item of m words is in a document if some stretch of the document is within ``EDITS`` * m word
edits of it. A random walk (CGK embedding) turns a word sequence into one in which few edits become
few differing places: at step t it writes the current word and moves on if a random bit of (t, word)
says so. Item-sized windows of the documents and the items are walked alike; samples of the written
places (``WALKS`` walks, ``SAMPLES`` samples of ``PLACES`` places) are the hash keys under which
they meet. Windows that meet an item are verified by the exact edit distance, and the distance and the
place that are returned are those over the whole document.

Before the walk, windows are dropped that can't match by counting: d edits leave at least
m - 1 - 2d of an item's adjacent word pairs whole, so a window that holds fewer pairs of any item is
none. Items of nearly one length share a walk and so a count: the least over their own lengths (the count is not
monotone in m: an item of 10 words may lose 4 of its 9 pairs, one of 9 words only 2 of 8). Nothing is lost by
it, and few windows are left to walk. An item of fewer than ``WALKED`` words allows no edit at all: its places are found exactly, by hash.

Items are a stated query set: they go to the executors in blocks of ``ITEM_BYTES`` of text, each of
which is one pass over the documents. A block's walks are made in the Python workers (about 45 bytes for
a byte of text); with several blocks, each result is written before the next block is read, so the driver holds one
block's text at a time. Documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, documents, forget, text_bytes, written
from .words import word_hashes, words

EDITS = 0.2
WALKED = 5
WALKS, SAMPLES, PLACES = 10, 12, 2
CLASS_RATIO = 1.15
ITEM_BYTES = 2 << 20
SLICE_BYTES = 2 << 20
_END = np.uint64(0x5BF03635)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def pairs(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * np.uint64(31) + hashes[1:])


_LOW = np.uint64((1 << 20) - 1)


def marks(values: np.ndarray) -> np.ndarray:
    """A table of the low bits of ``values``, so that most strangers are told apart without a search."""
    out = np.zeros(1 << 20, bool)
    out[values & _LOW] = True
    return out


def among(values: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``, whose marks are ``table``."""
    out = table[values & _LOW]
    maybe = np.flatnonzero(out)
    own = values.ravel()[maybe] if values.ndim > 1 else values[maybe]
    out.ravel()[maybe] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    return out


@dataclass
class Class:
    """Items of nearly the same number of words, and the keys of their walks: sorted, with the item of each."""

    least: int
    most: int
    needed: int  # the fewest pairs that a match of any of the items leaves whole
    steps: int
    keys: np.ndarray
    owners: np.ndarray
    marks: np.ndarray

    @property
    def reach(self) -> int:
        return self.most + edits(self.most)


@dataclass
class Items:
    ids: list
    hashes: list[np.ndarray]
    pairs: np.ndarray
    marks: np.ndarray
    repeats: int
    classes: list[Class]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted keys of the items, and which they are


def edits(m: int) -> int:
    """The most edits at which an item of ``m`` words still counts as found."""
    return int(EDITS * m + 1e-9)


def walk_keys(sequence: np.ndarray, starts: np.ndarray, limit: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """(starts, WALKS * SAMPLES) keys of the windows of ``sequence`` that begin at ``starts`` and end before ``limit``."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(starts), WALKS * SAMPLES), np.uint64)
    wide = np.concatenate([sequence, [_END]])
    for walk in range(WALKS):
        salt = rng.integers(1, 1 << 63, steps).astype(np.uint64)
        picked = np.sort(np.stack([rng.choice(steps, PLACES, replace=False) for _ in range(SAMPLES)]), 1)
        at = starts.copy()
        written = np.empty((steps, len(starts)), np.uint64)
        for t in range(steps):
            word = np.where(at < limit, wide[np.minimum(at, len(sequence))], _END)
            written[t] = word
            at = at + (mixed(word ^ salt[t]) & np.uint64(1)).astype(np.int64)
        for s, places in enumerate(picked):
            key = np.full(len(starts), walk * SAMPLES + s, np.uint64)
            for p in places:
                key = mixed(key * np.uint64(0x100000001B3) + written[p])
            out[:, walk * SAMPLES + s] = key
    return out


def run_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of ``n`` words."""
    keys = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        keys = mixed(keys * np.uint64(31) + hashes[k : len(hashes) - n + 1 + k])
    return keys


def prepare(items: list[tuple[object, bytes]]) -> Items:
    """The walks of items (id, UTF-8 text), and the keys of the short ones; those without any word are left out."""
    held = [(i, word_hashes(t)) for i, t in items]
    held = sorted(((i, h) for i, h in held if len(h)), key=lambda x: len(x[1]))
    classes, short, k = [], {}, 0
    while k < len(held) and len(held[k][1]) < WALKED:
        n, first = len(held[k][1]), k
        while k < len(held) and len(held[k][1]) == n:
            k += 1
        keys = np.concatenate([run_keys(h, n) for _, h in held[first:k]])
        order = np.argsort(keys, kind="stable")
        short[n] = keys[order], order + first
    walked = held[k:]
    while k < len(held):
        least = len(held[k][1])
        stop = k
        while stop < len(held) and len(held[stop][1]) <= least * CLASS_RATIO:
            stop += 1
        own = [h for _, h in held[k:stop]]
        steps = max(PLACES, int(1.6 * least))
        ends = np.cumsum([len(h) for h in own])
        keys = walk_keys(np.concatenate(own), ends - [len(h) for h in own], ends, steps, least)
        order = np.argsort(keys.ravel(), kind="stable")
        ordered = keys.ravel()[order]
        needed = min(len(h) - 1 - 2 * edits(len(h)) for h in own)
        classes.append(Class(least, len(own[-1]), needed, steps, ordered, np.repeat(np.arange(k, stop), keys.shape[1])[order], marks(ordered)))
        k = stop
    hashes = [h for _, h in held]
    known = np.unique(np.concatenate([pairs(h) for _, h in walked])) if walked else np.empty(0, np.uint64)
    repeats = max((int(np.unique(pairs(h), return_counts=True)[1].max()) for _, h in walked), default=0)
    return Items([i for i, _ in held], hashes, known, marks(known), repeats, classes, short)


def infix_distance(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance of ``item`` to a stretch of each window (rows), and where the first such stretch ends."""
    n = windows.shape[1] + 1
    ramp = np.arange(n)
    row = np.zeros((len(windows), n), np.int64)  # a stretch may begin anywhere
    for i, word in enumerate(item):
        fresh = np.empty_like(row)
        fresh[:, 0] = i + 1
        fresh[:, 1:] = np.minimum(row[:, :-1] + (windows != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(fresh - ramp, axis=1) + ramp
    return row.min(1), row.argmin(1)


def found(items: Items, sequence: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, word at which the stretch ends) for each row of ``sequence`` and each item in it.

    ``rows`` are the word numbers at which rows start, and the end. Of several places, the closest and then the first.
    """
    out = []
    for r, i in sorted(set(_short(items, sequence, rows)) | set(_walked(items, sequence, rows))):
        distance, end = infix_distance(items.hashes[i], sequence[None, rows[r] : rows[r + 1]])
        out.append((r, i, int(distance[0]), int(end[0])))
    return out


def _short(items: Items, sequence: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, item) of the items of fewer than WALKED words."""
    for n, (known, owners) in items.short.items():
        if len(sequence) < n:
            continue
        keys = run_keys(sequence, n)
        low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
        at = np.flatnonzero(high > low)
        row = np.searchsorted(rows, at, "right") - 1
        inside = at + n <= rows[row + 1]
        for r, a, b in set(zip(row[inside].tolist(), low[at][inside].tolist(), high[at][inside].tolist(), strict=True)):
            yield from ((r, int(i)) for i in owners[a:b])


def _walked(items: Items, sequence: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, item) of the other items."""
    if len(sequence) < 2 or not items.classes:
        return
    own = pairs(sequence)
    hit = among(own, items.pairs, items.marks)
    hit[rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(sequence))] - 1] = False  # pairs across rows
    # of one pair over and over, an item holds ``repeats`` at most: those further inside such a run don't count
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.concatenate([heads, [len(own)]]))
    past = np.arange(len(own)) - np.repeat(heads, size)
    hit &= (past < items.repeats) | (np.repeat(size, size) - past <= items.repeats)
    total = np.concatenate([[0], np.cumsum(hit)])
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    candidates: list[np.ndarray] = []
    for c in items.classes:
        first = np.arange(len(sequence))
        last = np.minimum(first + c.reach - 1, len(own))
        starts = np.flatnonzero(total[last] - total[first] >= c.needed) if c.needed > 0 else first
        starts = starts[rows[row_of[starts] + 1] - starts >= c.least - edits(c.least)]
        for k in range(0, len(starts), 1 << 14):
            s = starts[k : k + (1 << 14)]
            keys = walk_keys(sequence, s, rows[row_of[s] + 1], c.steps, c.least)
            met = np.flatnonzero(among(keys, c.keys, c.marks))
            low = np.searchsorted(c.keys, keys.ravel()[met], "left")
            counts = np.searchsorted(c.keys, keys.ravel()[met], "right") - low
            each = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            owners = c.owners[np.repeat(low, counts) + each]
            candidates.append(np.unique(np.stack([owners, np.repeat(s[met // keys.shape[1]], counts)], 1), axis=0))
    if not candidates:
        return
    every = np.unique(np.concatenate(candidates), axis=0)
    for item in np.unique(every[:, 0]):
        goal = items.hashes[item]
        most = edits(len(goal))
        starts = every[every[:, 0] == item, 1]
        width = len(goal) + 3 * most
        # the same count as above, of this item's own pairs
        needed = len(goal) - 1 - 2 * most
        if needed > 0:
            mine = np.unique(pairs(goal))
            table = marks(mine)
            low = np.maximum(starts - most, rows[row_of[starts]])
            place = low[:, None] + np.arange(width - 1)
            inside = place < rows[row_of[starts] + 1][:, None] - 1
            starts = starts[(among(own[np.minimum(place, len(own) - 1)], mine, table) & inside).sum(1) >= needed]
        for k in range(0, len(starts), 4096):
            s = starts[k : k + 4096]
            low = np.maximum(s - most, rows[row_of[s]])
            place = low[:, None] + np.arange(width)
            inside = place < rows[row_of[s] + 1][:, None]
            distance, _ = infix_distance(goal, np.where(inside, sequence[np.minimum(place, len(sequence) - 1)], np.uint64(0)))
            yield from ((int(r), int(item)) for r in np.unique(row_of[s[distance <= most]]))


def _benchmark_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")


def block_count(benchmark: DataFrame) -> int:
    """The number of blocks of about ITEM_BYTES that the items' texts fill."""
    return -(-(_benchmark_rows(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)


def item_blocks(benchmark: DataFrame, n: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items (item_id, text) of a table in ``n`` blocks, dealt by id and text so that equal texts do not fill one block. Null texts are left out."""
    rows = _benchmark_rows(benchmark)
    for k in range(n):
        yield [(r["item_id"], bytes(r["text"])) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


_prepared: dict[int, Items] = {}


def _in_worker(block: list[tuple[object, bytes]], number: int) -> Items:
    """The walks of a block, made once in a worker; the block before it is let go."""
    if number not in _prepared:
        _prepared.clear()
        _prepared[number] = prepare(block)
    return _prepared[number]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, distance, end_word): each item that is in each document; a document without any has no row.

    ``n_words`` is the item's length, ``distance`` the least over the document, ``end_word`` the word after the first stretch
    of that distance. Null and empty texts hold nothing; items of null text or without any word are not looked for. Repeated rows
    are each judged, null ids too; equal items are each found. Very long texts are searched whole, one to a slice. Of ``docs`` only
    doc_id and text are read, so other columns may have any name. An empty table gives an empty result.
    """
    schema = "doc_id long, item_id long, n_words int, distance int, end_word int"
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def search(block: list[tuple[object, bytes]]):
        number = uuid.uuid4().int

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _in_worker(block, number)
            for batch in batches:
                for part in byte_slices(batch, "text", SLICE_BYTES):
                    own = words(*text_bytes(part.column(1)))
                    ids = part.column(0).to_pylist()
                    out = [(ids[r], items.ids[i], len(items.hashes[i]), d, e) for r, i, d, e in found(items, own.hashes, own.rows)]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "n_words", "distance", "end_word"])

        return run

    out, n = docs.sparkSession.createDataFrame([], schema), block_count(benchmark)
    for block in item_blocks(benchmark, n):
        part = rows.mapInArrow(search(block), schema)
        out = out.union(part if n == 1 else written(part, "found"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``contaminated`` for nulls, repeats and the rest.

    Each block of items filters what the one before it left; with several blocks, each result is written.
    """
    at = docs.columns.index("text")

    def keep(block: list[tuple[object, bytes]]):
        number = uuid.uuid4().int

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _in_worker(block, number)
            for batch in batches:
                for part in byte_slices(batch, batch.schema.names[at], SLICE_BYTES):
                    own = words(*text_bytes(part.column(at)))
                    mask = np.ones(part.num_rows, bool)
                    mask[[*{r for r, _ in _short(items, own.hashes, own.rows)}, *{r for r, _ in _walked(items, own.hashes, own.rows)}]] = False
                    yield part.filter(pa.array(mask))

        return run

    n, before = block_count(benchmark), None
    for block in item_blocks(benchmark, n):
        docs = docs.mapInArrow(keep(block), docs.schema)
        if n > 1:
            docs = written(docs, "clean")
            if before is not None:
                forget(before)
            before = docs
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` in every document; see ``contaminated`` for nulls, empty and very long texts, ties and repeats."""
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

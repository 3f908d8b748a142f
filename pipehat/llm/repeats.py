"""Removal of long byte strings that occur earlier in the corpus, by a run-length index.

A string of ``LENGTH`` bytes is removed wherever it also starts earlier (smaller doc_id, or same
document and earlier start). How the work is dealt out:

1. Equal texts: the first keeps the text; the others repeat it as a whole. Distinct texts are packed
   into blocks of about ``BLOCK_BYTES``, and written in buckets by block: that is the one shuffle of whole texts, later steps read the blocks where they lie.
2. Every window of ``LENGTH`` bytes is owned by an anchor, the least of its ``ANCHOR``-byte strings by
   hash. Equal windows have equal anchors, so only windows of anchors that occur twice are looked at.
   Each block sends an anchor once however often it holds it, so no anchor has more rows than blocks.
3. The text around the windows of a repeated anchor (a segment) goes to the anchor. Of equal segments of one anchor a block sends
   the first (a partial aggregation before the shuffle: the others are marked at once). Segments of many
   anchors make one text, for which a run-compressed Burrows-Wheeler transform is built, with the
   suffix-array samples at the run ends. From those samples alone, matching statistics stream
   along the text: within a run, the neighbour in suffix order moves on by one and the match shortens by
   one. Windows linked by matches of LENGTH or more are equal; all but the first are marked.
4. An anchor's segments come in corpus order, about ``INDEX_BYTES`` at a time, each time with the segments before that held a window
   of their own. To bound those, an anchor with more than ``HOT_SEGMENTS`` segments is split by the symbols next to it: of the bytes of a window that are
   not known to be equal yet, half is taken in on the side where the window has that many. Equal windows are split alike, so they stay together;
   after seven splits the windows of a part are all equal. The index decides there as everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, documents, forget, text_bytes, texts, written

LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1
BLOCK_BYTES = 2 << 20
PIECE = 1 << 20
INDEX_BYTES = 1 << 20
HOT_SEGMENTS = 10_000
_PLACE = np.uint64((1 << 22) - 1)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each place on; one place per whole anchor."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while width < ANCHOR:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h = h[:-width] * np.uint64(factor) + h[width:]
        h ^= h >> np.uint64(31)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64) | 1
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(x) - width + 1
    whole = -(-len(x) // width) * width
    rows = np.concatenate([x, np.full(whole - len(x), np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def owned_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of each run of windows with one anchor; windows lie within a row."""
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return empty
    hashes = anchor_hashes(data)
    owner = sliding_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), SPAN) & _PLACE
    edges = np.zeros(len(owner) + 1, np.int32)
    a = offsets[:-1][np.diff(offsets) >= LENGTH]
    b = offsets[1:][np.diff(offsets) >= LENGTH] - LENGTH + 1
    np.add.at(edges, a, 1)
    np.add.at(edges, b, -1)
    inside = np.cumsum(edges[:-1]) > 0
    starts = np.ones(len(owner), bool)
    starts[1:] = (owner[1:] != owner[:-1]) | ~inside[:-1]
    starts[a] = True
    first = np.flatnonzero(starts & inside)
    if not len(first):
        return empty
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~starts[1:], [False]])) + 1
    return first, stops - first, hashes[owner[first].astype(np.int64)]


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Cuts rows into buffers of about PIECE bytes: (row of each part, start within the row, bytes, offsets); cut rows overlap by LENGTH - 1."""
    held: list[tuple[int, int, int, int]] = []

    def out():
        sizes = np.cumsum([0] + [b - a for _, _, a, b in held])
        rows = np.array([r for r, _, _, _ in held]), np.array([s for _, s, _, _ in held])
        return *rows, np.concatenate([data[a:b] for _, _, a, b in held]), sizes

    size = 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for k in range(a, max(b - LENGTH + 1, a), PIECE):
            end = min(b, k + PIECE + LENGTH - 1)
            if size and size + end - k > 2 * PIECE:
                yield out()
                held, size = [], 0
            held.append((row, k - a, k, end))
            size += end - k
    if held:
        yield out()


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The places in suffix order, and the ranks by 7, 14, 28, ... symbols.

    ``left`` is the number of symbols up to the end of the place's segment; suffixes end there, and
    equal ones follow in text order (as if each segment ended in a sign of its own).
    """
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | np.where(left > i, wide[i : n + i], 0)
    levels, width = [], 7
    order = np.argsort(key, kind="stable")
    while True:
        ordered = key[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        number = np.cumsum(fresh)
        rank = np.empty(n, np.int64)
        rank[order] = number
        levels.append((width, rank))
        longest = int(left.max(initial=0))
        if number[-1] == n or width >= longest:
            return order, levels
        # only places whose rank is shared are ordered again, each among its equals
        shared = ~fresh | ~np.concatenate([fresh[1:], [True]])
        at = order[shared]
        beyond = np.where(left[at] > width, np.concatenate([rank, np.zeros(width, np.int64)])[at + width], 0)
        key = rank * np.int64(n + 1)
        key[at] += beyond
        again = np.argsort(key[at], kind="stable")
        order[shared] = at[again]
        width *= 2


def common_prefix(a: np.ndarray, b: np.ndarray, symbols: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, by the ranks of each power."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    room = np.minimum(left[a], left[b])
    last = len(symbols) - 1
    for width, rank in reversed(levels):
        fits = out + width <= room
        same = fits & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        step = np.where(same, width, 0)
        a, b, out = a + step, b + step, out + step
    for _ in range(6):
        same = (out < room) & (symbols[np.minimum(a, last)] == symbols[np.minimum(b, last)])
        a, b, out = a + same, b + same, out + same
    return out


class RunIndex:
    """The run-compressed transform of a text of segments: run heads in text order, with the suffix that
    precedes each in suffix order and the match of the two. That is all that matching needs."""

    def __init__(self, symbols: np.ndarray, left: np.ndarray, starts: np.ndarray):
        self.n = len(symbols)
        order, levels = suffix_order(symbols, left)
        before = np.empty(self.n, np.int64)  # the transform: the sign before each suffix; segment starts have a sign of their own
        before[1:] = symbols[:-1]
        before[starts] = -1 - np.arange(len(starts))
        transform = before[order]
        heads = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        tails = order[heads[1:] - 1]  # sampled run ends: the last suffix of each run, then the first of the next
        first = order[heads[1:]]
        match = common_prefix(first, tails, symbols, left, levels)
        by_text = np.argsort(np.concatenate([first, order[:1]]))
        self.at = np.concatenate([first, order[:1]])[by_text]
        self.neighbour = np.concatenate([tails, [-1]])[by_text]
        self.match = np.concatenate([match, [0]])[by_text]
        self.runs = len(heads)

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place in text order: the suffix before it in suffix order, and how long the two match."""
        place = np.arange(self.n)
        run = np.searchsorted(self.at, place, "right") - 1
        gone = place - self.at[run]
        return self.neighbour[run] + gone, self.match[run] - gone


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Places of the joined ``segments`` (in corpus order) where a string of ``length`` starts that also starts earlier."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"".join(segments), np.uint8)
    left = np.repeat(ends, sizes) - np.arange(len(symbols))
    before, match = RunIndex(symbols, left, ends - sizes).matching()
    linked = np.flatnonzero(match >= length)
    # follow the links to the end of each chain of equal windows; the least place of a chain stays
    jump = np.arange(len(symbols))
    jump[linked] = before[linked]
    while True:
        further = jump[jump[linked]]
        if (further == jump[linked]).all():
            break
        jump[linked] = further
    first = np.arange(len(symbols))
    np.minimum.at(first, jump[linked], linked)
    marked = np.union1d(linked, jump[linked])
    return marked[first[jump[marked]] != marked]


SEGMENTS = "anchor long, doc_id long, ord long, block long, row int, start int, windows int, segment binary"
MARKS = "block long, row int, start int, windows int"


def bucket_of(block: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of ``n``, that Spark puts a long value into: its 32-bit Murmur3 hash with seed 42, modulo ``n``."""
    u = np.uint32
    turn = lambda x, k: (x << u(k)) | (x >> u(32 - k))
    block = np.asarray(block, np.int64).view(np.uint64)
    h = np.full(block.shape, 42, u)
    for half in ((block & np.uint64(0xFFFFFFFF)).astype(u), (block >> np.uint64(32)).astype(u)):
        h = turn(h ^ turn(half * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32).astype(np.int64) % n


def own_blocks(task: int, n: int) -> Iterator[int]:
    """Block numbers that only this task uses and that fall into one of ``n`` buckets: what a task writes is one file, and stays together."""
    start = task << 32
    while True:
        found = np.arange(start, start + max(4 * n, 1024))
        yield from found[bucket_of(found, n) == task % n].tolist()
        start += len(found)


def _blocks(n_buckets: int):
    """Numbers blocks of about BLOCK_BYTES of text, and the rows in each; exactly repeated rows go once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = own_blocks(TaskContext.get().partitionId(), n_buckets)
        number, row, size, seen = next(numbers), 0, 0, set()
        for batch in batches:
            keep, blocks, rows = [], [], []
            sizes = np.diff(text_bytes(batch.column(2))[1]).tolist()
            for i, (doc, sha, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, strict=True)):
                if (doc, sha) in seen:
                    continue
                seen.add((doc, sha))
                if row and size + n > BLOCK_BYTES:
                    number, row, size = next(numbers), 0, 0
                keep.append(i)
                blocks.append(number)
                rows.append(row)
                row, size = row + 1, size + n
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blocks, pa.int64()), pa.array(rows, pa.int32())], ["doc_id", "sha", "text", "block", "row"])

    return blocks


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, block with a low bit that says whether the anchor occurs more than once here)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        blocks = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found = [owned_runs(x, o)[2] for _, _, x, o in pieces(*own)]
            if found:
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.int64(blocks[a]) * 2 + (counts > 1))], ["anchor", "place"])


def _segments(group: pa.Table, repeated: pa.Table) -> pa.Table:
    """The segments of one block at repeated anchors; of equal ones, the first (the others are marked: null segment)."""
    group = group.sort_by("row") if group.num_rows else group
    out: list[tuple] = []
    if group.num_rows and repeated.num_rows:
        known = np.sort(repeated["anchor"].to_numpy().view(np.uint64))
        data, offsets = text_bytes(group["text"])
        # the same pieces as when the anchors were found; what lies at their edges is not lost, only cut there
        ids, ords = group["doc_id"].to_pylist(), group["ord"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ords[i]))
        rank = {row: k for k, row in enumerate(order)}
        hits = []
        for rows, begins, buffer, ends in pieces(data, offsets):
            first, windows, hashes = owned_runs(buffer, ends)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            own = np.flatnonzero(known[at] == hashes)
            part = np.searchsorted(ends, first[own], "right") - 1
            raw = buffer.tobytes()
            for f, w, h, p in zip(first[own].tolist(), windows[own].tolist(), hashes[own].view(np.int64).tolist(), part.tolist(), strict=True):
                row = int(rows[p])
                hits.append((rank[row], int(begins[p]) + f - int(ends[p]), row, w, h, raw[f : f + w + LENGTH - 1]))
        hits.sort(key=lambda x: x[:2])
        block, seen = group["block"][0].as_py(), set()
        for _, start, row, w, h, segment in hits:
            again = segment in seen
            seen.add(segment)
            out.append((None if again else h, ids[row], ords[row], block, row, start, w, None if again else segment))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["anchor", "doc_id", "ord", "block", "row", "start", "windows", "segment"]
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)


def _ranges(places: np.ndarray, rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Marked places of the joined segments of ``rows`` as (block, row, start, windows)."""
    if not len(places):
        return []
    ends = np.cumsum([len(r[5]) for r in rows])
    own = np.searchsorted(ends, places, "right")
    heads = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1] + 1) | (own[1:] != own[:-1])]))
    counts = np.diff(np.concatenate([heads, [len(places)]]))
    begins = places[heads] - (ends[own[heads]] - np.array([len(r[5]) for r in rows])[own[heads]])
    return [(rows[o][2], rows[o][3], rows[o][4] + b, c) for o, b, c in zip(own[heads].tolist(), begins.tolist(), counts.tolist(), strict=True)]


def index_marks(rows: list[tuple], old: int = 0) -> tuple[list[tuple[int, int, int, int]], list[tuple]]:
    """Marks of ``rows`` (doc_id, ord, block, row, start, segment, windows, anchor) in corpus order, and the rows that hold a window of their own.

    The first ``old`` rows were judged before and get no marks. Equal segments are one text of the index: the first of them; and an
    anchor with one such text repeats nothing but that.
    """
    marks, first, variety = [], {}, {}
    for k, r in enumerate(rows):
        if r[5] in first:
            marks.append((r[2], r[3], r[4], r[6]))
        else:
            first[r[5]] = k
            variety[r[7]] = variety.get(r[7], 0) + 1
    own = list(first.values())
    asked = [k for k in own if variety[rows[k][7]] > 1]
    repeated = np.zeros(len(rows), np.int64)
    if asked:
        places = repeated_windows([rows[k][5] for k in asked])
        owner = np.searchsorted(np.cumsum([len(rows[k][5]) for k in asked]), places, "right")
        repeated[asked] = np.bincount(owner, minlength=len(asked))
        marks += _ranges(places[np.array(asked)[owner] >= old] if len(places) else places, [rows[k] for k in asked])
    return marks, [rows[k] for k in own if k < old or repeated[k] < rows[k][6]]


def corpus_order(row: tuple) -> tuple:
    return row[0] is None, row[0] or 0, row[1], row[2], row[3], row[4]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of segments that come by anchor, and each anchor's in corpus order."""
    held: list[tuple] = []
    old, size, most = 0, 0, INDEX_BYTES

    def found(rows: list[tuple], n_old: int) -> tuple[pa.RecordBatch, list[tuple]]:
        if not n_old:
            rows = sorted(rows, key=corpus_order)  # of several anchors
        marks, own = index_marks(rows, n_old)
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in marks], pa.int64()) for i in range(4)], ["block", "row", "start", "windows"]), own

    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if held and r[7] != held[-1][7]:
                if old or size > INDEX_BYTES:
                    yield found(held, old)[0]
                    held, old, size, most = [], 0, 0, INDEX_BYTES
            elif size > 2 * most:  # in the middle of an anchor
                first = next(k for k, x in enumerate(held) if x[7] == r[7])
                if first:  # the anchors before it are whole
                    yield found(held[:first], 0)[0]
                    held = held[first:]
                marks, held = found(held, old)
                yield marks
                old, size = len(held), sum(len(x[5]) for x in held)
                most = max(INDEX_BYTES, size)
            held.append(r)
            size += len(r[5])
    if held:
        yield found(held, old)[0]


def split_segment(anchor: int, start: int, windows: int, segment: bytes, low: int | None, high: int | None) -> list[tuple]:
    """The parts (anchor, start, windows, segment, low, high) of a segment by the symbols next to what its windows have in common.

    Bytes ``low`` to ``high`` of the segment are common to all windows of the anchor; at first that is the anchor itself.
    """
    if low is None:
        low = int(np.flatnonzero(anchor_hashes(np.frombuffer(segment, np.uint8)).view(np.int64) == anchor)[0])
        high = low + ANCHOR
    unseen = LENGTH - (high - low)
    if not unseen:
        return [(anchor, start, windows, segment, low, high)]
    half = -(-unseen // 2)
    cut = min(max(high + half - LENGTH, 0), windows)  # windows from here on have ``half`` bytes or more behind the common ones
    out = []
    for first, stop, a, b, side in ((0, cut, low - (unseen - half + 1), high, b"<"), (cut, windows, low, high + half, b">")):
        if first < stop:
            key = xxhash.xxh64_intdigest(side + segment[a:b], anchor & (1 << 64) - 1)
            out.append((key - (1 << 64) if key >> 63 else key, start + first, stop - first, segment[first : stop - 1 + LENGTH], a - first, b - first))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "doc_id", "ord", "block", "row", "start", "windows", "segment", "low", "high"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            out = []
            for anchor, doc, order, block, row, start, windows, segment, low, high in zip(*(batch.column(i).slice(k, 2000).to_pylist() for i in range(10)), strict=True):
                out += [(x[0], doc, order, block, row, *x[1:]) for x in split_segment(anchor, start, windows, segment, low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)


def cooled(sent: DataFrame, hot_segments: int) -> DataFrame:
    """``sent`` (segments) with those of anchors beyond ``hot_segments`` split until no part has more, or its windows are equal."""
    rows = sent.select("anchor", "doc_id", "ord", "block", "row", "start", "windows", "segment", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    done = None
    for _ in range(7):
        hot = written(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("high") - F.col("low")), F.lit(0)).alias("known")).where((F.col("n") > hot_segments) & (F.col("known") < LENGTH)).select("anchor"), "hot")
        if hot.isEmpty():
            break
        cool = rows.join(hot, "anchor", "left_anti")
        done = cool if done is None else done.union(cool)
        rows = written(rows.join(hot, "anchor", "left_semi").select(rows.columns).mapInArrow(_split, f"{SEGMENTS.replace('segment binary', '')}segment binary, low int, high int"), "split")
    return rows if done is None else done.union(rows)


def _kept(group: pa.Table, marks: pa.Table) -> pa.Table:
    """What remains of each text of a block."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for row, start, windows in zip(marks["row"].to_pylist(), marks["start"].to_pylist(), marks["windows"].to_pylist(), strict=True):
        spans.setdefault(row, []).append((start, start + windows + LENGTH - 1))
    out = []
    for doc, sha, row, text in zip(group["doc_id"].to_pylist(), group["sha"].to_pylist(), group["row"].to_pylist(), texts(group["text"].combine_chunks() if group["text"].num_chunks else pa.array([], pa.string())), strict=True):
        if row not in spans:
            continue
        joined: list[list[int]] = []
        for a, b in sorted(spans[row]):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        past, digest = 0, hashlib.sha256()
        for a, b in joined:
            digest.update(text[past:a])
            past = b
        digest.update(text[past:])
        out.append((doc, sha, sum(b - a for a, b in joined), len(joined), digest.hexdigest()))
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["of_id", "of_sha", "removed", "spans", "kept"])


def judged(blocks: DataFrame, hot_segments: int) -> DataFrame:
    """(of_id, of_sha, removed, spans, kept) of the texts of ``blocks`` that lose something."""
    keyed = blocks.withColumn("ord", F.xxhash64("sha"))

    anchors = blocks.select("text", "block").mapInArrow(_anchors, "anchor long, place long")
    every = "count(*) over (partition by anchor) + max(place % 2) over (partition by anchor)"
    repeated = anchors.withColumn("times", F.expr(every)).where("times > 1").select("anchor", F.expr("place div 2").alias("block"))
    repeated = written(repeated, "repeated")
    grouped = keyed.select("block", "row", "doc_id", "ord", "text").groupBy("block")
    segments = written(grouped.cogroup(repeated.groupBy("block")).applyInArrow(_segments, SEGMENTS), "segments")

    sent = cooled(segments.where("segment is not null"), hot_segments).select("doc_id", "ord", "block", "row", "start", "segment", "windows", "anchor")
    sent = sent.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").isNull(), "doc_id", "ord", "block", "row", "start")
    marks = segments.where("segment is null").select(*(F.col(c).cast("long") for c in ("block", "row", "start", "windows")))
    marks = written(marks.union(sent.mapInArrow(_marked, "block long, row long, start long, windows long")), "marks")

    kept = blocks.select("block", "doc_id", "sha", "row", "text").groupBy("block").cogroup(marks.groupBy("block"))
    kept = written(kept.applyInArrow(_kept, "of_id long, of_sha binary, removed long, spans long, kept string"), "kept")
    forget(repeated, segments, marks)
    return kept


def without_repeats(docs: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    Null texts count as empty; texts of fewer than LENGTH bytes lose nothing. Documents are taken by
    doc_id, null ids last, and rows of one id by the digest of their text; exactly repeated rows of one
    id are one document, and each gets its result. Ties between equal strings go to the earlier place. Very long texts are cut into
    overlapping pieces, a block each. Of ``docs`` only doc_id and text are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    ids = written(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "ids")
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    firsts = ids.groupBy("sha").agg(F.min(order)["doc_id"].alias("first_id"), F.max("n_bytes").alias("n")).where(F.col("n") >= LENGTH)
    firsts = written(firsts.select(F.col("sha").alias("first_sha"), "first_id"), "firsts")
    alike = (F.col("sha") == F.col("first_sha")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    distinct = rows.join(firsts.hint("shuffle_hash"), alike, "left_semi").select("doc_id", "sha", "text")
    n_buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    blocks = bucketed(distinct.mapInArrow(_blocks(n_buckets), "doc_id long, sha binary, text binary, block long, row int"), "blocks", n_buckets, "block", "row")
    try:
        kept = judged(blocks, hot_segments)
    finally:
        forget(blocks)
    kept = kept.join(firsts, (F.col("of_sha") == F.col("first_sha")) & F.col("of_id").eqNullSafe(F.col("first_id")), "full")
    kept = kept.select(F.coalesce("of_sha", "first_sha").alias("of_sha"), "first_id", "removed", "spans", "kept")
    out = ids.join(kept, F.col("sha") == F.col("of_sha"), "left")
    copy = F.col("of_sha").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each text of ``documents``; see ``without_repeats`` for nulls, empty and very long texts, ties and repeated rows."""
    return without_repeats(documents(spark, sf_dir, "doc_id", "text"))

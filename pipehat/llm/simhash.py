"""SimHash near-duplicate groups, compared with bit-sliced Hamming distances.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Distinct
fingerprints meet in buckets (pigeonhole: four blocks of 16 bits, two of which must agree when at
most two bits differ). Within a bucket, fingerprints lie as vertical bit planes, 64 to a machine
word; carry-save counters add up 64 distances at a time and a word is abandoned as soon as all of
its live lanes exceed the radius. Buckets with more than ``HOT_BUCKET`` fingerprints are split
again by three parts of their free bits (one of which must agree), twice at most: after that, no
more than 15 bits are free, so a bucket holds at most 32,768 fingerprints at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts, written
from .components import components

SHINGLE_WORDS = 3
RADIUS = 2
HOT_BUCKET = 2048
LANES = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of UTF-8 text; 0 without words.

    A-Z count as a-z, words are runs of bytes other than ASCII white space, a text with fewer words
    than a shingle is one shingle, and repeated shingles vote repeatedly.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = words[k : min(k + (1 << 16), n) + words_per_shingle - 1]
        runs = zip(*(part[i:] for i in range(min(words_per_shingle, len(words)))), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        votes += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, words_per_shingle) for x in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _parts(positions: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(positions, n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(positions: list[int]) -> int:
    return _signed(sum(1 << p for p in positions))


def masks(radius: int = RADIUS) -> tuple[list[int], dict[int, list[int]]]:
    """The masks of the first buckets, and of each mask the masks that split its hot buckets."""
    blocks = _parts(list(range(64)), radius + 2)
    first = [(i, j) for i in range(len(blocks)) for j in range(i)]
    roots, split, level = [], {}, []
    for pair in first:
        fixed = [p for i in pair for p in blocks[i]]
        roots.append(_mask(fixed))
        level.append(fixed)
    for _ in range(2):
        below = []
        for fixed in level:
            free = [p for p in range(64) if p not in set(fixed)]
            own = [sorted(fixed + part) for part in _parts(free, radius + 1)]
            split[_mask(fixed)] = [_mask(x) for x in own]
            below += own
        level = below
    return roots, split


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of ``fps`` (uint64): row b holds bit b of all of them, 64 to a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _lanes(flags: np.ndarray) -> np.ndarray:
    n = -(-len(flags) // 64) * 64
    padded = np.zeros(n, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def close_lanes(planes: np.ndarray, shift: int, live: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes i of ``live`` (packed) whose fingerprint lies within ``radius`` (0 to 3) bits of that of lane i + shift."""
    wide = np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)
    step, rest = divmod(shift, 64)
    at = np.flatnonzero(live)
    alive = live[at]
    ones = np.zeros(len(at), np.uint64)
    twos, over = ones.copy(), ones.copy()
    last = planes.shape[1]
    for low in range(0, 64, 8):
        rows = slice(low, low + 8)
        moved = wide[rows, np.minimum(at + step, last)] >> np.uint64(rest)
        if rest:
            moved |= wide[rows, np.minimum(at + step + 1, last)] << np.uint64(64 - rest)
        for differ in wide[rows, at] ^ moved:
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
        beyond = over | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.uint64(0) * ones}[radius]
        alive &= ~beyond
        keep = alive != 0
        if not keep.all():
            at, alive, ones, twos, over = (x[keep] for x in (at, alive, ones, twos, over))
            if not len(at):
                break
    words = np.zeros(last, np.uint64)
    words[at] = alive
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Lane pairs that join all close fingerprints with equal keys (sorted); a spanning forest, not all pairs."""
    root = np.arange(len(fps))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    planes, out, shift = planes_of(fps), [], 1
    while shift < len(fps):
        same = keys[:-shift] == keys[shift:]
        if not same.any():
            break
        for i in close_lanes(planes, shift, _lanes(np.concatenate([same, np.zeros(shift, bool)])), radius):
            x, y = top(int(i)), top(int(i) + shift)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(i), int(i) + shift))
        shift += 1
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(keys, fps):
        pairs = np.array(bucket_links(keys, fps), np.int64).reshape(-1, 2)
        found = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[pairs[:, 0]]), pa.array(found[pairs[:, 1]])], ["a", "b"])

    def flush(final: bool):
        nonlocal held
        if not held:
            return
        keys = np.concatenate([k for k, _ in held])
        fps = np.concatenate([f for _, f in held])
        first = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        number, heads = np.cumsum(first), np.flatnonzero(first)
        end = len(keys) if final else int(heads[-1])
        if end:
            yield links(number[:end], fps[:end])
        held = [(keys[end:], fps[end:])] if end < len(keys) else []

    rows = 0
    for batch in batches:
        mask, key, fp = (batch.column(i).to_numpy() for i in range(3))
        held.append((np.stack([mask, key], 1), fp.view(np.uint64)))
        rows += len(fp)
        if rows >= LANES:
            yield from flush(False)
            rows = sum(len(f) for _, f in held)
    yield from flush(True)


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): fingerprints of ``distinct`` (fp) at most RADIUS bits apart; enough of them to connect all that are."""
    roots, split = masks()
    rows = distinct.select(F.explode(F.array(*map(F.lit, roots))).alias("mask"), "fp")
    keyed = lambda df: df.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    rows = keyed(rows)
    for _ in range(2):
        hot = rows.groupBy("mask", "key").count().where(F.col("count") > hot_bucket).select("mask", "key")
        hot = written(hot, "hot")
        if hot.isEmpty():
            break
        table = F.create_map(*[F.lit(x) if i == 0 else F.array(*map(F.lit, x)) for k, v in split.items() for i, x in enumerate((k, v))])
        below = rows.join(hot, ["mask", "key"], "left_semi").select(F.explode(table[F.col("mask")]).alias("mask"), "fp")
        rows = rows.join(hot, ["mask", "key"], "left_anti").select("mask", "key", "fp").union(keyed(below))
    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Texts whose fingerprints differ in two bits or fewer are linked; ``component_id`` is the smallest
    doc_id reachable over links. Null and empty texts have fingerprint 0 and are linked like others.
    Repeated rows keep one result row each; a null doc_id gets its component, and is the id of none
    (a component of null ids only has a null id). Very long texts vote shingle by shingle, whole; ties are to the smallest id, and a bit that half
    of the shingles set is 0. Other columns are not read. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = written(components(links(distinct.select("fp"))), "components")
    placed = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return fps.join(placed, F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and group of every document; see ``near_duplicates`` for nulls, empty and very long texts, ties and repeated rows."""
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

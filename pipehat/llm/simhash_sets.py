"""SimHash near-duplicate groups by similarity: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

At similarity 0.8 two sets of one size enclose an angle of 27 degrees, so that the bits of their SimHash differ with a
chance of 0.15 each: far more than the few bits of a copy. Three things make up for it:

1. Fingerprints have ``BITS`` bits, and meet in tables keyed by a sample of their bits. ``tables`` says how many tables of how
   many bits: more bits as the corpus grows, so that a bucket holds about ``CROWD`` strangers, and as many more tables as
   keep the chance of a miss where it is.
2. Within a bucket, fingerprints lie as vertical bit planes, 64 to a machine word. Carry-save adders count 64 distances at a time,
   eight planes a step; the counters start so high that they overflow beyond ``RADIUS``, and words without a live lane are abandoned.
3. Every link is decided by the exact similarity of the two sets.

Groups of any size don't make all pairs. A bucket gives a spanning forest of its close fingerprints, and the forests of all tables
give candidate groups, within which every pair that the tables propose lies. The set of each text goes once to its candidate group,
where the exact similarities decide: first to the most common text, then of what is still apart from the largest part. Candidate groups
beyond ``GROUP_TEXTS`` or ``GROUP_SHINGLES`` are decided bucket by bucket instead, of all tables.

A bucket of more than about ``HOT_BUCKET`` texts (a sample of the texts says which: that deals out work and decides no pair) is dealt to parts, with one
text of it, its head, in each; what the parts leave apart from the head is then held against all parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, forget, texts, written
from .components import components
from .simhash import LANES, _signed

SHINGLE_WORDS = 5
#: The least similarity, as a fraction of whole numbers, so that no rounding decides a pair.
LEAST = (4, 5)
BITS = 128
#: Bits that may differ: at similarity 0.8, 19.4 are expected with a deviation of 4.1; texts with nothing in common have 64.
RADIUS = 36
CROWD = 1024
FEWEST_BITS = 14
#: The chance that a pair at exactly the least similarity, of the expected distance, meets in no table.
MISS = 2e-4
HOT_BUCKET = 8192
SHIFTS = 32
QUERIES = 64
HOT_SAMPLE = 64
GROUP_TEXTS = 8192
#: Tables of ids and digests of up to so many rows (some 50 MB) are sent to all executors, so that texts are not shuffled.
SENT_ROWS = 1_500_000
GROUP_SHINGLES = 1 << 23
BLOCK_BYTES = 8 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; a text with fewer words than a shingle is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[i:] for i in range(min(size, len(words)))), strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as two words: of each hash, its bits and those of a second hash vote."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        one = hashes[k : k + (1 << 14)]
        two = (one ^ (one >> np.uint64(31))) * _MIX
        both = np.stack([one, two ^ (two >> np.uint64(29))], 1)
        bits = np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        votes += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += bits[whole:].sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def close(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of LEAST or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def tables(n: int) -> list[tuple[int, int]]:
    """For ``n`` distinct texts, the masks (two signed words) of the bits that key each table."""
    bits = max(FEWEST_BITS, (n // CROWD).bit_length())
    similarity = LEAST[0] / LEAST[1]
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(MISS) / math.log(1 - same**bits))
    rng, out = np.random.default_rng(20), []
    while len(out) < count:
        places = rng.permutation(BITS)
        for k in range(0, BITS - bits + 1, bits):
            mask = sum(1 << int(p) for p in places[k : k + bits])
            out.append((_signed(mask & (1 << 64) - 1), _signed(mask >> 64)))
    return out[:count]


# ---- bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of ``fps`` (n, 2): row b holds bit b of all of them, 64 to a word."""
    wide = np.zeros((-(-len(fps) // 64) * 64, BITS // 64), np.uint64)
    wide[: len(fps)] = fps
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _packed(flags: np.ndarray) -> np.ndarray:
    """The last axis of ``flags`` packed, 64 to a word."""
    n = -(-flags.shape[-1] // 64) * 64
    padded = np.zeros((*flags.shape[:-1], n), bool)
    padded[..., : flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: (carries, sums)."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def within(differ: Callable[[slice, np.ndarray], np.ndarray], live: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The lanes of ``live`` (packed words) whose distance is ``radius`` (63 at most) or less, packed.

    ``differ(rows, at)`` gives the differing lanes of the planes ``rows`` at the words ``at``.
    """
    out = np.zeros_like(live)
    at = np.flatnonzero(live)
    alive = live[at]
    over = np.zeros(len(at), np.uint64)
    counter = [np.full(len(at), _ALL if 63 - radius >> k & 1 else np.uint64(0)) for k in range(6)]
    for low in range(0, BITS, 8):
        d = differ(slice(low, low + 8), at)
        ones, twos, fours = counter[:3]
        a, ones = _add(ones, d[0], d[1])
        b, ones = _add(ones, d[2], d[3])
        e, twos = _add(twos, a, b)
        a, ones = _add(ones, d[4], d[5])
        b, ones = _add(ones, d[6], d[7])
        f, twos = _add(twos, a, b)
        carry, fours = _add(fours, e, f)
        counter[:3] = ones, twos, fours
        for k in (3, 4, 5):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        alive &= ~over
        keep = alive != 0
        if not keep.all():
            at, alive, over = at[keep], alive[keep], over[keep]
            counter = [x[keep] for x in counter]
            if not len(at):
                return out
    out[at] = alive
    return out


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def at_shift(planes: np.ndarray, shift: int, live: np.ndarray) -> np.ndarray:
    """Lanes i with ``live`` whose fingerprint is close to that of lane i + shift."""
    wide = np.concatenate([planes, np.zeros((BITS, 1), np.uint64)], axis=1)
    step, rest = divmod(shift, 64)
    last = planes.shape[1]

    def differ(rows: slice, at: np.ndarray) -> np.ndarray:
        moved = wide[rows, np.minimum(at + step, last)] >> np.uint64(rest)
        if rest:
            moved |= wide[rows, np.minimum(at + step + 1, last)] << np.uint64(64 - rest)
        return wide[rows, at] ^ moved

    return _lanes(within(differ, _packed(live)))


def of_queries(planes: np.ndarray, queries: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
    """For each lane of ``queries``, the lanes with ``live`` (queries, lanes) that are close to it."""
    words = planes.shape[1]
    bits = np.where(planes[:, queries // 64] >> (queries % 64).astype(np.uint64) & np.uint64(1), _ALL, np.uint64(0))

    def differ(rows: slice, at: np.ndarray) -> np.ndarray:
        return planes[rows, at % words] ^ bits[rows, at // words]

    found = within(differ, _packed(live).ravel()).reshape(len(queries), words)
    return [_lanes(f) for f in found]


def close_pairs(groups: np.ndarray, fps: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """A forest of pairs of lanes of one group (sorted) with close fingerprints and sizes that allow the similarity.

    Lanes of one label count as joined; together with the labels, the pairs join all that any close pairs do.
    """
    out: list[tuple[int, int]] = []
    root = np.unique(labels, return_inverse=True)[1].reshape(-1)
    root = np.unique(groups * (int(root.max(initial=0)) + 1) + root, return_inverse=True)[1].reshape(-1)  # a group knows nothing of another's links
    first = np.full(int(root.max(initial=0)) + 1, len(root))
    np.minimum.at(first, root, np.arange(len(root)))
    root = first[root]  # lanes point at a lane of their label

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def take(i: int, j: int) -> None:
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))

    def settle() -> None:
        while True:
            further = root[root]
            if (further == root).all():
                return
            root[:] = further

    fits = lambda i, j: np.minimum(sizes[i], sizes[j]) * LEAST[1] >= np.maximum(sizes[i], sizes[j]) * LEAST[0]
    planes = planes_of(fps)
    for shift in range(1, SHIFTS + 1):
        if shift >= len(groups) or not (same := groups[:-shift] == groups[shift:]).any():
            return out
        settle()
        own = np.arange(len(same))
        live = same & (root[:-shift] != root[shift:]) & fits(own, own + shift)
        for i in at_shift(planes, shift, live).tolist():
            take(i, i + shift)
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if b - a <= SHIFTS + 1:
            continue
        settle()
        names, counts = np.unique(root[a:b], return_counts=True)
        asked = np.flatnonzero(root[a:b] != names[counts.argmax()])  # pairs within the largest label need no look
        is_asked = np.zeros(b - a, bool)
        is_asked[asked] = True
        planes, places = planes_of(fps[a:b]), np.arange(b - a)
        for k in range(0, len(asked), QUERIES):
            some = asked[k : k + QUERIES]
            settle()
            live = (np.abs(some[:, None] - places) > SHIFTS) & (root[a + some][:, None] != root[a:b]) & fits(a + some[:, None], a + places)
            live &= ~is_asked | (places > some[:, None])  # a pair of two asked lanes is looked at once
            for q, lanes in zip(some.tolist(), of_queries(planes, some, live), strict=True):
                for i in lanes.tolist():
                    take(a + min(q, i), a + max(q, i))
    return out


def stars(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lanes that ``pairs`` join, each with the least lane it is joined to (not those that are least themselves)."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := root.setdefault(i, i)) != i:
            root[i] = root.setdefault(j, j)
            i = root[i]
        return i

    for i, j in pairs:
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    lanes = [i for i in list(root) if top(i) != i]
    return np.array(lanes, np.int64), np.array([top(i) for i in lanes], np.int64)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted bucket rows (bucket, part, node, n, one, two, label) to stars of what close nodes join (bucket, part, a, b): a is the least of b's."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        if not held:
            return
        whole = [np.concatenate([h[i] for h in held]) for i in range(7)]
        fresh = np.concatenate([[True], (whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1])])
        end = len(fresh) if final else int(np.flatnonzero(fresh)[-1])
        if end:
            bucket, part, node, n, one, two, label = (x[:end] for x in whole)
            fps = np.stack([one.view(np.uint64), two.view(np.uint64)], 1)
            lanes, heads = stars(close_pairs(np.cumsum(fresh[:end]), fps, n, label))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[lanes], part[lanes], node[heads], node[lanes])], ["bucket", "part", "a", "b"])
        held = [[x[end:] for x in whole]] if end < len(fresh) else []
        rows = len(fresh) - end

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy() for i in range(7)])
            rows += batch.num_rows
        if rows >= LANES:
            yield from flush(False)
    yield from flush(True)


def _close(rows: DataFrame) -> DataFrame:
    """Stars (bucket, part, a, b) of what the close nodes of each bucket part join, of ``rows`` (bucket, part, node, n, one, two, label)."""
    rows = rows.select("bucket", "part", "node", F.col("n").cast("long").alias("n"), "one", "two", "label")
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node").mapInArrow(_compared, "bucket long, part long, a long, b long").where("a <> b")


# ---- exact similarities


def similar_pairs(sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """A forest of pairs of ``sets`` that are similar enough; sets of one label count as joined."""
    root, out = [labels.index(x) for x in labels] if len(sets) < 64 else None, []
    if root is None:
        first: dict[int, int] = {}
        root = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(i, j), max(i, j)))

    if len(sets) < 12:
        for j in range(len(sets)):
            for i in range(j):
                if top(i) != top(j) and close(sets[i], sets[j]):
                    join(i, j)
        return out
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    lists, ends = owner[order], np.cumsum(counts)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def alike(i: int) -> np.ndarray:
        """The sets that are similar enough to set i."""
        own = column[starts[i] : starts[i + 1]]
        common = np.bincount(np.concatenate([lists[ends[c] - counts[c] : ends[c]] for c in own]), minlength=len(sets))
        return np.flatnonzero(common * LEAST[1] >= (sizes[i] + sizes - common) * LEAST[0])

    middle = int(np.argmax(np.bincount(owner, counts[column].astype(float)) / sizes))  # the set whose shingles most others have
    for j in alike(middle).tolist():
        join(middle, j)
    tops = np.array([top(i) for i in range(len(sets))])
    names, times = np.unique(tops, return_counts=True)
    for i in np.flatnonzero(tops != names[times.argmax()]).tolist():  # pairs within the largest part need no look
        for j in alike(i).tolist():
            join(i, j)
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, part, node, label, hashes) to forests of similar nodes (a, b)."""
    held: list[tuple] = []
    out: list[tuple[int, int]] = []

    def finish() -> None:
        pairs = similar_pairs([np.frombuffer(x[4], np.uint64) for x in held], [x[3] for x in held])
        out.extend((min(held[i][2], held[j][2]), max(held[i][2], held[j][2])) for i, j in pairs)

    def links() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[-1][:2] != row[:2]:
                finish()
                held = []
            held.append(row)
        yield links()
        out = []
    if held:
        finish()
    yield links()


def _similar(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the nodes of each group of ``rows`` (group, part, node, label) that are similar enough; sets are (set_node, hashes)."""
    rows = rows.join(sets, F.col("node") == F.col("set_node")).select("group", "part", "node", "label", "hashes")
    return rows.repartition("group", "part").sortWithinPartitions("group", "part", "node").mapInArrow(_decided, "a long, b long").where("a <> b")


# ---- the groups


def key(text: Column) -> Column:
    """A digest of a text's bytes; texts without words, null too, have one digest."""
    return F.when(F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))).otherwise(F.lit(b""))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, "text", BLOCK_BYTES):
            sizes, prints = [], []
            for text in texts(part.column(2)):
                hashes = shingles(text.lower().split())
                sizes.append(len(hashes))
                prints.append(fingerprint(hashes))
            both = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "key", "n", "one", "two"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node, once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for part in byte_slices(batch, "text", BLOCK_BYTES):
            nodes = part.column(0).to_pylist()
            fresh = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
            own = part.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([shingles(x.lower().split()).tobytes() for x in texts(own.column(1))], pa.binary())], ["node", "hashes"])


def _joined(stars_of: DataFrame) -> DataFrame:
    """(node, root) of what the stars of all tables join.

    A node has one head a table at most; all its heads are linked to the least of them, which leaves about one edge a node, however many tables or texts a group has.
    """
    heads = stars_of.groupBy("b").agg(F.collect_set("a").alias("heads")).select("b", F.array_min("heads").alias("least"), "heads")
    heads = written(heads, "heads")
    edges = heads.select(F.col("least").alias("a"), "b").union(heads.select(F.col("least").alias("a"), F.explode("heads").alias("b")).distinct())
    out = written(components(edges), "candidates")
    forget(heads)
    return out


def small(table: DataFrame, n: int) -> DataFrame:
    """``table``, to be sent to all executors if its ``n`` rows of a few bytes are few enough."""
    return F.broadcast(table) if n <= SENT_ROWS else table


def _sets_of(nodes: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(set_node, hashes) of ``nodes`` (node)."""
    needed = written(distinct.join(nodes, "node", "left_semi").select("node", F.col("key").alias("own_key")), "needed")
    rows = docs.where("text is not null").select(key(F.col("text")).alias("key"), "text").join(small(needed, needed.count()), F.col("key") == F.col("own_key")).select("node", "text")
    out = written(rows.mapInArrow(_sets, "node long, hashes binary").groupBy(F.col("node").alias("set_node")).agg(F.first("hashes").alias("hashes")), "sets")
    forget(needed)
    return out


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with ``label``: the root of the node in ``found`` (node, root), or the node."""
    out = rows.join(found.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    return out.withColumn("label", F.coalesce("root", "node")).drop("linked", "root")


def _strays(spread: DataFrame, dealt: DataFrame, hot: DataFrame, found: DataFrame) -> DataFrame | None:
    """Rows (bucket, part, node, ..., label) that hold what is apart from its hot bucket's head against all parts; None if nothing is."""
    head = _named(hot.select("bucket", "parts", F.col("head.node").alias("node")), found).select("bucket", "parts", F.col("label").alias("head_label"))
    out = _named(spread, found).join(head, "bucket").where("label <> head_label")
    out = written(out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "head_label"), "strays")
    if out.isEmpty():
        return None
    beside = _named(dealt.join(out.select("bucket", "part").distinct(), ["bucket", "part"], "left_semi"), found)
    return out.unionByName(beside).distinct()


def near_duplicates(docs: DataFrame, hot_bucket: int = HOT_BUCKET, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """(doc_id, key, component_id, root) for every row of ``docs`` (doc_id, text); ``key`` is a digest of the text.

    Texts that are similar enough are linked; ``component_id`` is the smallest doc_id reachable over links, null if
    no id is; ``root`` names the component even then. A-Z count as a-z and white space separates words. Null, empty and
    wordless texts are one group. Repeated rows keep one result row each, ties are by node number and change no group. Very long texts
    are sketched whole. Of ``docs`` only doc_id and text are read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(rows.select("doc_id", key(F.col("text")).alias("key"), "text").mapInArrow(_sketched, "doc_id long, key binary, n long, one long, two long"), "sketches")
    distinct = sketches.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("one").alias("one"), F.first("two").alias("two"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("node"), "*"), "distinct")

    masks = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, (a, b) in enumerate(tables(distinct.count()))))
    buckets = F.transform(masks, lambda m: F.xxhash64(m["t"], F.col("one").bitwiseAND(m["a"]), F.col("two").bitwiseAND(m["b"])))
    spread_of = lambda df: df.where("n > 0").select(F.explode(buckets).alias("bucket"), "node", "n", "one", "two")
    spread, share = spread_of(distinct), max(1, min(HOT_SAMPLE, hot_bucket // 64))
    sample = spread_of(distinct.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0))
    hot = sample.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n", "one", "two")).alias("head")).where(F.col("size") * share > hot_bucket)
    hot = written(hot.select("bucket", F.ceil(F.col("size") * share / hot_bucket).cast("long").alias("parts"), "head"), "hot")
    any_hot = not hot.isEmpty()
    dealt = spread.withColumn("part", F.lit(0).cast("long"))
    if any_hot:
        parts = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("long")
        dealt = spread.join(hot.select("bucket", "parts"), "bucket", "left").select("bucket", "node", "n", "one", "two", parts.alias("part"))
        others = dealt.join(hot.select("bucket", F.col("head.node").alias("node")), ["bucket", "node"], "left_anti")
        dealt = others.union(hot.select("bucket", F.col("head.*"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))

    pairs = written(_close(dealt.withColumn("label", F.col("node"))), "close")
    found = _joined(pairs)
    if any_hot and (more := _strays(spread, dealt, hot, found)) is not None:
        pairs = written(pairs.union(_close(more)), "close")
        found = _joined(pairs)

    sets = _sets_of(found.select("node"), docs, distinct)
    sizes = found.join(distinct.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    large = written(sizes.where((F.col("texts") > group_texts) | (F.col("shingles") > GROUP_SHINGLES)).select("root"), "large")
    small = found if large.isEmpty() else found.join(large, "root", "left_anti")
    links = _similar(small.select(F.col("root").alias("group"), F.lit(0).cast("long").alias("part"), "node", F.col("node").alias("label")), sets)
    if not large.isEmpty():  # bucket by bucket
        inside = written(found.join(large, "root", "left_semi").select("node"), "inside")
        ends = pairs.select("bucket", "part", F.col("a").alias("node")).union(pairs.select("bucket", "part", F.col("b").alias("node"))).distinct()
        ends = ends.join(inside, "node", "left_semi").select(F.col("bucket").alias("group"), "part", "node", F.col("node").alias("label"))
        links = written(links.union(_similar(ends, sets)).distinct(), "links")
        if any_hot:
            joined = written(components(links), "components")
            own = spread.join(inside, "node", "left_semi").select("bucket", "node"), dealt.join(inside, "node", "left_semi").select("bucket", "part", "node")
            if (more := _strays(*own, hot, joined)) is not None:
                links = links.union(_similar(more.withColumnRenamed("bucket", "group"), sets))
    former = found
    found = written(components(links), "components")
    forget(former, sets, pairs, hot)

    placed = distinct.join(found.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    placed = placed.select("key", "first_id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = written(placed.join(least, "root").select(F.col("key").alias("own_key"), "component_id", "root"), "placed")
    forget(distinct, found)
    return sketches.join(placed, F.col("key") == F.col("own_key")).select("doc_id", "key", "component_id", "root")

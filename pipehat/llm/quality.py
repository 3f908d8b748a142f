"""Document quality from a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of it. Each byte is a small learned vector
plus two channels that say whether the bytes at that place have just been seen (4-byte and 2-byte
repeats within ``LAGS`` bytes). Learned filters slide over every chunk and are max-pooled over it;
the mean and the maximum of the pooled values over all chunks of the document go through a
logistic output. Chunk pools are merged as they come, so a document of any length needs the memory
of one block of chunks.

The filters learn by back-propagation from a bounded sample of labelled documents
(``SAMPLE_PER_CLASS`` of each class by hash order), each with all of its chunks, as they are scored; the
share of each class among all labelled documents then sets the output's offset, so that scores
are probabilities over the corpus. The two repeat channels are not learned: a filter of 12 bytes can't see that
bytes return after up to ``LAGS`` places, which is what tells text that repeats itself from text that doesn't; the weights on them are learned.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import byte_slices, documents, text_bytes

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 12, 4
EMBED, FILTERS = 6, 24
LAGS = 24
PAD = 256
THRESHOLD = 0.3
FOLDS = 5
SAMPLE_PER_CLASS = 700
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.01, 1e-4
BLOCK = 512


@dataclass
class Network:
    embed: np.ndarray  # (257, EMBED); the row of PAD stays 0
    filters: np.ndarray  # (WIDTH * (EMBED + 2), FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): weights of the mean and of the maximum over chunks
    offset: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.offset]


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of ``n`` bytes: one at least, together covering all bytes."""
    return np.arange(max(1, -(-(n - CHUNK) // STEP) + 1)) * STEP


def cut(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Chunks (len(starts), CHUNK) of ``data`` as uint16; places from ``stops`` on are PAD."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < stops[:, None]
    if not len(data):
        return np.full(at.shape, PAD, np.uint16)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint16(PAD))


def repeats(chunks: np.ndarray) -> np.ndarray:
    """(..., 2): whether the 4 and the 2 bytes from here on were also there at most LAGS bytes before."""
    wide = chunks.astype(np.uint32)
    pairs = wide[:, :-1] * np.uint32(257) + wide[:, 1:]
    pairs = np.concatenate([pairs, np.zeros((len(chunks), 1), np.uint32)], 1)
    fours = pairs.copy()
    fours[:, :-2] = pairs[:, :-2] * np.uint32(66049) + pairs[:, 2:]
    out = np.zeros((*chunks.shape, 2), bool)
    for k, codes in enumerate((fours, pairs)):
        seen = np.zeros(chunks.shape, bool)
        for lag in range(2, LAGS + 1):
            seen[:, lag:] |= codes[:, lag:] == codes[:, :-lag]
        out[..., k] = seen & (chunks != PAD)
    return out


def windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Inputs of the filters: (chunks, positions, WIDTH * (EMBED + 2))."""
    x = np.empty((*chunks.shape, EMBED + 2), np.float32)
    x[..., :EMBED] = net.embed[chunks]
    x[..., EMBED:] = repeats(chunks)
    n = (CHUNK - WIDTH) // STRIDE + 1
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), n, WIDTH, EMBED + 2), (a, STRIDE * b, b, c)).reshape(len(x), n, -1)


def pooled(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(chunks, FILTERS): the rectified filters, max-pooled over each chunk."""
    parts = [np.maximum((windows(net, chunks[k : k + BLOCK]) @ net.filters).max(1) + net.bias, 0) for k in range(0, len(chunks), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A probability for each text of ``data``, rounded to 6 places."""
    counts = np.array([max(1, -(-(n - CHUNK) // STEP) + 1) for n in np.diff(offsets)], np.int64)
    ends = np.cumsum(counts)
    total = np.zeros((len(counts), FILTERS))
    most = np.zeros((len(counts), FILTERS))
    for k in range(0, int(ends[-1]) if len(ends) else 0, 4 * BLOCK):
        number = np.arange(k, min(k + 4 * BLOCK, ends[-1]))
        doc = np.searchsorted(ends, number, "right")
        starts = offsets[doc] + (number - ends[doc] + counts[doc]) * STEP
        h = pooled(net, cut(data, starts, np.minimum(starts + CHUNK, offsets[doc + 1])))
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[heads]] += np.add.reduceat(h, heads)
        most[doc[heads]] = np.maximum(most[doc[heads]], np.maximum.reduceat(h, heads))
    margin = np.concatenate([total / counts[:, None], most], 1) @ net.out + net.offset[0]
    return np.round(sigmoid(margin), 6)


def _gradients(net: Network, docs: list[np.ndarray], labels: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """The loss's gradients over ``docs``, the chunks of each, every document counted as often as ``times`` says; memory is that of BLOCK chunks' windows, however long a document is."""
    sizes = np.array([len(d) for d in docs])
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    chunks = np.concatenate(docs)
    tops, parts = [], []
    for k in range(0, len(chunks), BLOCK):
        z = windows(net, chunks[k : k + BLOCK]) @ net.filters
        top = z.argmax(1)
        tops.append(top)
        parts.append(np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0] + net.bias, 0))
    h = np.concatenate(parts)
    mean, most = np.add.reduceat(h, heads) / sizes[:, None], np.maximum.reduceat(h, heads)
    pool = np.concatenate([mean, most], 1)
    error = (sigmoid(pool @ net.out + net.offset[0]) - labels) * times / times.sum()
    back = error[:, None] * net.out
    doc = np.repeat(np.arange(len(docs)), sizes)
    dh = back[doc, :FILTERS] / sizes[doc, None] + back[doc, FILTERS:] * (h == most[doc])
    dh *= h > 0
    dfilters, dembed = np.zeros(net.filters.shape), np.zeros(net.embed.shape)
    for k, top in zip(range(0, len(chunks), BLOCK), tops, strict=True):
        own, part = dh[k : k + BLOCK], chunks[k : k + BLOCK]
        rows = np.arange(len(part))[:, None]
        picked = windows(net, part)[rows, top]  # (chunks, FILTERS, WIDTH * channels)
        dfilters += np.einsum("cf,cfk->kf", own, picked)
        dx = (own[:, :, None] * net.filters.T).reshape(len(part), FILTERS, WIDTH, EMBED + 2)[..., :EMBED]
        bytes_at = part[rows[:, :, None], top[:, :, None] * STRIDE + np.arange(WIDTH)].ravel()
        dembed += np.stack([np.bincount(bytes_at, dx[..., e].ravel(), 257) for e in range(EMBED)], 1)
    dembed[PAD] = 0
    return [dembed, dfilters, dh.sum(0), pool.T @ error, np.array([error.sum()])]


def chunks_of(text: bytes) -> np.ndarray:
    """All chunks of a text."""
    starts = chunk_starts(len(text))
    return cut(np.frombuffer(text, np.uint8), starts, np.minimum(starts + CHUNK, len(text)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """A network from whole texts and their labels, by Adam on balanced batches."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(draw(257, EMBED, scale=0.3), draw(WIDTH * (EMBED + 2), FILTERS, scale=0.1), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, scale=0.3), np.zeros(1, np.float32))
    net.embed[PAD] = 0
    one, two = [np.zeros_like(p, np.float64) for p in net.parameters()], [np.zeros_like(p, np.float64) for p in net.parameters()]
    sides = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]
    sides = [s for s in sides if len(s)]
    step = 0
    for _ in range(EPOCHS):
        for _ in range(max(8, len(texts) // BATCH)):
            step += 1
            pick = np.concatenate([rng.choice(s, BATCH // len(sides)) for s in sides])
            pick, times = np.unique(pick, return_counts=True)
            for p, g, m, v in zip(net.parameters(), _gradients(net, [chunks_of(texts[i]) for i in pick], labels[pick], times), one, two, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.embed[PAD] = 0
    return net


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    At most ``per_class`` documents of each class are learned from, each whole: the driver holds their texts, and the
    chunks of one batch. Rows of either table with a null id or label teach nothing, a null text is empty. Of the rows of a repeated id, those
    after the sample is full are left out; which rows are in it hangs on hashes of id and text alone, ties are equal rows.
    Without any label all scores are 0.5 before training's random start; with one class only, its
    documents alone are learned. Very long texts cost as many chunks as they have. Other columns are not read.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    ids = picked[0].union(picked[1])  # 2 * per_class rows: a fixed bound
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("label", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), "id")
    place = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text")  # an id may have several rows: the bound is on rows
    held = [(r["label"], bytes(r["text"])) for r in rows.withColumn("k", F.row_number().over(place)).where(F.col("k") <= per_class).select("label", "text").collect()]
    held.sort()
    if not held:
        return train([b""], np.array([1.0]))
    y = np.array([float(k) for k, _ in held])
    net = train([t for _, t in held], y)
    if len(counts) == 2:
        net.offset += np.float32(np.log(counts[1] / counts[0]))  # batches were balanced
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``score``; null and empty texts are scored as one empty chunk.

    Equal texts get equal scores. Other columns, null ids and repeated rows stay; an input column of
    the name ``score`` is replaced.
    """
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 4 << 20):
                found = pa.array(scores(net, *text_bytes(part.column(at))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "score"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double")


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 when divided by FOLDS."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0


def crc_fold(doc_id: int) -> int:
    return binascii.crc32(str(doc_id).encode()) % FOLDS


def quality_network(spark: SparkSession, sf_dir: str) -> Network:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return fitted(documents(spark, sf_dir, "doc_id", "text"), labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row of ``documents``; see ``scored`` and ``fitted`` for nulls, empty and very long texts, ties and repeats. A null id is not held out."""
    found = scored(documents(spark, sf_dir, "doc_id", "text"), quality_network(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

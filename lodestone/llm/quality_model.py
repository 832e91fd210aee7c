"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing gives every word a sparse index vector (a few +1 and -1 at
places taken from its hash) and adds to a word's vector the index vectors of
its neighbours, over all documents.  Words share 2**16 rows by hash, so the
table has one size at any corpus; the sums are integers, so they don't depend
on partitioning.  The vectors are centred, shrunk for rare words and pooled per
document into a mean, a mean square and a mean product of neighbours.  A
two-layer numpy network is trained on a bounded sample of labelled documents;
its temperature is fitted on a part of them held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices
from .texthash import U64, Words, words

ROWS_BITS = 16
DIM = 32
REACH = 2
SHRINK = 20.0
#: Labelled documents used to fit the network, at most; those with the least hash of their id.
MOST_LABELLED = 20_000
HIDDEN = 32
KEEP_FROM = 0.5
_BLOCK = 1024


def _rows(found: Words) -> np.ndarray:
    return (found.hashes >> U64(64 - ROWS_BITS)).astype(np.int64)


def neighbour_sums(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(2**16 x DIM sums of neighbours' index vectors, occurrences by row) of a batch."""
    row, n = _rows(found), len(found.hashes)
    owner = found.owner()
    index = []
    weight = []
    for k in range(2):  # the two places of the index vector
        place = ((found.hashes >> U64(16 * k)) & U64(DIM - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((found.hashes >> U64(16 * k + 8)) & U64(1)).astype(np.float64)
        for gap in range(1, REACH + 1):
            if n <= gap:
                continue
            same = owner[gap:] == owner[:-gap]
            index += [(row[:-gap] * DIM + place[gap:])[same], (row[gap:] * DIM + place[:-gap])[same]]
            weight += [sign[gap:][same], sign[:-gap][same]]
    cells = DIM << ROWS_BITS
    sums = np.bincount(np.concatenate(index), np.concatenate(weight), cells) if index else np.zeros(cells)
    return sums.astype(np.int64).reshape(-1, DIM), np.bincount(row, minlength=1 << ROWS_BITS)


def word_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """2**16 rows of DIM sums and a count, over all documents.

    A task sends the sums of its partition in blocks of rows, which are added
    up by block; the driver gets one table of fixed size (17 MB).
    """

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << ROWS_BITS, DIM + 1), np.int64)
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                sums, count = neighbour_sums(words(part.column(0).to_pylist(), lower=False))
                total[:, :DIM] += sums
                total[:, DIM] += count
        if not total[:, DIM].any():
            return
        small = total.astype(np.int32) if np.abs(total).max() < 2**31 else total
        blocks = range(0, len(total), _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK for k in blocks], pa.int32()), pa.array([small.itemsize for _ in blocks], pa.int32()), pa.array([small[k : k + _BLOCK].tobytes() for k in blocks], pa.binary())], names=["block", "size", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, size, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(sums.as_buffer(), f"<i{size}")
                total[block] = total[block] + part if block in total else part.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(part_sums, "block int, size int, sums binary")
    out = np.zeros((1 << ROWS_BITS, DIM + 1), np.int64)
    for r in parts.repartition("block").mapInArrow(added, "block int, sums binary").collect():
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.sums, np.int64).reshape(_BLOCK, DIM + 1)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Centred and shrunk word vectors, scaled to a mean square of 1 over the words of the corpus."""
    vector, count = sums[:, :DIM].astype(np.float64), sums[:, DIM:].astype(np.float64)
    centre = vector.sum(0) / max(count.sum(), 1.0)
    vector = (vector - count * centre) / (count + SHRINK)
    scale = np.sqrt((count * vector**2).sum() / max(count.sum() * DIM, 1.0))
    return (vector / (scale or 1.0)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 3 DIM features, word counts)."""
    found = words(texts, lower=False)
    n = np.diff(found.first)
    out = np.zeros((len(texts), 3 * DIM), np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out, n
    v = vectors[_rows(found)]
    pair = np.zeros_like(v)
    np.multiply(v[:-1], v[1:], out=pair[:-1])
    pair[found.first[some + 1] - 1] = 0  # a text's last word has no successor
    at = found.first[some]
    for k, x in enumerate((v, v * v, pair)):
        out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(x, at, axis=0) / n[some][:, None]
    return out, n


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, from 0.5 to 20, by golden-section search."""

    def loss(t: float) -> float:
        z = logit / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    lo, hi, g = np.log(0.5), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, hidden: int = HIDDEN, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature on the rest.

    Without both classes the probability is the share of 1 among the labels,
    or 0.5 without labels.
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    rng = np.random.Generator(np.random.PCG64(seed))
    width = x.shape[1] if x.ndim == 2 else 3 * DIM
    net = Network(np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    if len(np.unique(y)) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, train = order[:cut], order[cut:]
    net.mean, net.scale = x[train].mean(0), x[train].std(0) + 1e-6
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    step = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 256):
            at = train[k : k + 256]
            h = np.tanh(z[at] @ weights[0] + weights[1])
            g = 1 / (1 + np.exp(-(h @ weights[2] + weights[3]))) - y[at]
            back = np.outer(g, weights[2]) * (1 - h * h)
            grads = [z[at].T @ back / len(at) + decay * weights[0], back.mean(0), h.T @ g / len(at) + decay * weights[2], np.array([g.mean()])]
            step += 1
            for w, d, m, s in zip(weights, grads, first, second):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    net.temperature = fit_temperature(net.logit(x[held]), y[held])
    return net


def labelled_features(docs: DataFrame, labels: DataFrame, vectors, id_col: str, text_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the ``most`` labelled documents with the least hash, in the order of the hash.

    The sample is bounded, so it is sent to the documents, which are read in
    place; of rows that repeat an id the one with the least features counts.
    """
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("double").alias("y"))
    sample = sample.withColumn("h", F.xxhash64("__id")).orderBy("h", "__id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(sample), "__id").select(F.struct("h", "__id", "y").alias("key"), "text")

    def work(keys: pa.Array, texts: list) -> dict:
        x, _ = pooled(texts, vectors.value)
        return {"h": keys.field(0), "id": keys.field(1), "y": keys.field(2), "x": [r.tobytes() for r in x]}

    made = map_texts(joined, "key", "text", work, "h long, id long, y double, x binary")
    one = made.groupBy("h", "id").agg(F.min(F.struct("x", "y")).alias("r")).select("h", "id", "r.x", "r.y")  # of rows that repeat an id
    rows = sorted(one.collect(), key=lambda r: (r.h, r.id))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]) if rows else np.zeros((0, 3 * DIM), np.float32)
    return x, np.array([r.y for r in rows])


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_from: float = KEEP_FROM, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, n_words, quality, keep) for every document; ``quality`` is the calibrated probability of label 1.

    Null, empty and wordless texts have quality 0; a very long one is pooled
    whole.  A null id stays null.  Other columns, whatever their names, are
    not read.  Labels
    that are null or not 0 or 1, or without an id, are ignored; of several for
    an id the greatest counts.  Without labels of both kinds every text has
    the share of label 1 (0.5 without labels).  Rows that repeat are scored
    each.  An empty table gives no row.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(word_sums(docs, text_col)))
    net = context.broadcast(fit(*labelled_features(docs, labels, vectors, id_col, text_col, label_col, most_labelled)))

    def work(ids: pa.Array, texts: list) -> dict:
        x, n = pooled(texts, vectors.value)
        p = np.where(n > 0, net.value.probability(x), 0.0)
        return {"doc_id": ids, "n_words": n, "quality": p, "keep": p >= keep_from}

    return map_texts(docs, id_col, text_col, work, "doc_id long, n_words long, quality double, keep boolean")

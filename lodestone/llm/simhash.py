"""SimHash near-duplicates: 128-bit fingerprints, exact tiled comparison.

Candidates come from an exact pigeonhole: the fingerprint is cut into
radius + agree blocks, so two fingerprints within the radius agree on ``agree``
blocks or more.  Rows that agree on the first of those are sent to one bucket;
there they are grouped by the other ones, and each group is sorted by
population count, cut into tiles and compared tile by tile with exclusive-or
and bit counts.  A tile pair whose population counts differ by more than the
radius cannot hold a pair and is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, without
from .components import components
from .texthash import U64, Words, mix, words

BITS = 128
RADIUS = 20
#: Groups up to this size are compared in stacks of tiles, larger ones tile by tile.
STACKED = 64
_LANE = U64(0x0101010101010101)


def _distinct(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text, as 48-bit values beside the text's number."""
    key = (found.owner().astype(U64) << U64(48)) | (found.hashes >> U64(16))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & U64((1 << 48) - 1), (key >> U64(48)).astype(np.int64)


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 words of 64 bits, whether there is a fingerprint); at most 65,536 texts at a time.

    The features are the distinct lower-cased words of the whole text.  Bit k
    is the majority of bit k over the features' hashes (a tie gives 0).  Texts
    without a word have no fingerprint.  Sums are kept in byte lanes of 64-bit
    integers, 255 features at a time, so a text of any length is exact.
    """
    feature, owner = _distinct(words(texts))
    out = np.zeros((len(texts), BITS // 64), U64)
    count = np.bincount(owner, minlength=len(texts))
    start = np.cumsum(count) - count
    pieces = (count + 254) // 255
    of = np.repeat(np.arange(len(texts)), pieces)
    if not len(of):
        return out, count > 0
    at = start[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    docs = of[head]
    for half in range(BITS // 64):
        h = mix(feature + U64(0x5851F42D4C957F2D * (half + 1) & (2**64 - 1)))
        word = np.zeros(len(docs), U64)
        for b in range(8):
            lanes = np.add.reduceat((h >> U64(b)) & _LANE, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
            on = (2 * np.add.reduceat(lanes, head, axis=0) > count[docs][:, None]).astype(U64)
            for j in range(8):
                word |= on[:, j] << U64(8 * j + b)
        out[docs, half] = word
    return out, count > 0


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo) for each row whose id is not null and whose text has a word."""

    def work(ids: pa.Array, texts: list) -> dict:
        fp, has = fingerprints(texts)
        keep = np.flatnonzero(has)
        fp = fp[keep].view(np.int64)
        return {"id": ids.take(pa.array(keep)), "hi": fp[:, 0], "lo": fp[:, 1]}

    return map_texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col, work, "id long, hi long, lo long")


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block; widths differ by one at most."""
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]


def block_values(fp: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """(blocks x n) the bits of each block; a block may straddle the two words."""
    out = np.zeros((len(blocks), len(fp)), np.uint16)
    for k, (first, width) in enumerate(blocks):
        word, at = divmod(first, 64)
        value = fp[:, word] >> U64(at)
        if at + width > 64:
            value = value | (fp[:, word + 1] << U64(64 - at))
        out[k] = (value & U64((1 << width) - 1)).astype(np.uint16)
    return out


def choose_agree(n: int, radius: int, most: int = 4) -> int:
    """The number of blocks to agree on with the least cost for n fingerprints.

    Every choice gives the same groups.  More blocks mean more groupings
    within a bucket of far smaller groups; what is shuffled stays radius +
    agree rows a fingerprint.  The unit is the comparison of a pair in a tile:
    ordering a row costs about 100, a call for a group 10,000, and a pair in a
    stack of small tiles 8.
    """

    def cost(agree: int) -> float:
        blocks = radius + agree
        groups = 2.0 ** (BITS * agree / blocks)
        pairs = n * n / groups / 2
        compare = pairs + 10_000 * groups if n > STACKED * groups else 8 * pairs
        return math.comb(blocks, agree) * (100 * n + compare)

    return min(range(1, most + 1), key=cost)


def tile_pairs(fp: np.ndarray, radius: int, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius among the rows of ``fp``, tile by tile; a tile's working memory stays in cache."""
    population = np.bitwise_count(fp).sum(axis=1).astype(np.int64)
    order = np.argsort(population, kind="stable")
    fp, population = np.ascontiguousarray(fp[order].T), population[order]
    n = len(order)
    differ, bits, more = np.empty((tile, tile), U64), np.empty((tile, tile), np.uint8), np.empty((tile, tile), np.uint8)
    for i in range(0, n, tile):
        top = population[min(i + tile, n) - 1]
        a = fp[:, i : i + tile, None]
        for j in range(i, n, tile):
            if population[j] - top > radius:
                break  # and so do all later tiles
            b = fp[:, None, j : j + tile]
            at = np.s_[: a.shape[1], : b.shape[2]]
            distance = np.bitwise_count(np.bitwise_xor(a[0], b[0], out=differ[at]), out=bits[at])
            for k in range(1, len(fp)):
                distance += np.bitwise_count(np.bitwise_xor(a[k], b[k], out=differ[at]), out=more[at])
            if i != j and distance.min() > radius:
                continue
            x, y = np.divmod(np.flatnonzero((distance <= radius).ravel()), b.shape[2])
            if i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield order[i + x], order[j + y]


def stacked_pairs(fp: np.ndarray, groups: np.ndarray, sizes: np.ndarray, radius: int, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius in many small groups at once: groups of like size are one stack of tiles.

    ``groups`` are the places at which groups begin in ``fp``.
    """
    room = 1 << np.ceil(np.log2(sizes)).astype(np.int64)
    for side in np.unique(room).tolist():
        own = np.flatnonzero(room == side)
        inner = np.arange(side)
        upper = inner[:, None] < inner[None]
        for lo in range(0, len(own), max(1, cells // side**2)):
            part = own[lo : lo + max(1, cells // side**2)]
            at = groups[part, None] + np.minimum(inner, sizes[part, None] - 1)
            tile = fp[at]
            distance = np.bitwise_count(tile[:, :, None, 0] ^ tile[:, None, :, 0])
            for k in range(1, fp.shape[1]):
                distance += np.bitwise_count(tile[:, :, None, k] ^ tile[:, None, :, k])
            g, x, y = np.nonzero((distance <= radius) & upper)
            there = y < sizes[part[g]]
            if there.any():
                g, x, y = g[there], x[there], y[there]
                yield at[g, x], at[g, y]


class Forest:
    """Least-index labels of the components of the pairs seen so far, all in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        differ = self.label[x] != self.label[y]
        if differ.any():
            self.pending.append((x[differ], y[differ]))
            self.many += int(differ.sum())
            if self.many > 1 << 14:
                self.settle()

    def settle(self) -> np.ndarray:
        """Hook the greater label of every pair below the lesser one and jump to the roots until no pair differs."""
        if self.pending:
            x, y = (np.concatenate(z) for z in zip(*self.pending))
            while len(x):
                a, b = self.label[x], self.label[y]
                differ = a != b
                x, y, a, b = x[differ], y[differ], a[differ], b[differ]
                np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
                while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                    self.label = up
            self.pending, self.many = [], 0
        return self.label


def bucket_edges(ids: np.ndarray, fp: np.ndarray, block: int, radius: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the near pairs of a bucket whose first equal block is ``block`` (or a later one).

    Rows are grouped by every choice of ``agree`` - 1 later blocks; the edges
    are fewer than the rows, however many pairs there are.
    """
    blocks = block_bounds(radius + agree)
    values = block_values(fp, blocks)
    forest = Forest(len(ids))
    for chosen in combinations(range(block + 1, len(blocks)), agree - 1):
        key = np.zeros(len(ids), np.int64)
        for k in chosen:
            key = key << blocks[k][1] | values[k]
        order = np.argsort(key, kind="stable")
        same = key[order]
        edge = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1], [True]]))
        sizes, sorted_fp = np.diff(edge), fp[order]
        label = forest.label[order]
        apart = np.maximum.reduceat(label, edge[:-1]) != np.minimum.reduceat(label, edge[:-1])  # groups that are not one component already
        small = np.flatnonzero(apart & (sizes <= STACKED))
        for x, y in stacked_pairs(sorted_fp, edge[small], sizes[small], radius):
            forest.add(order[x], order[y])
        for g in np.flatnonzero(apart & (sizes > STACKED)).tolist():
            at = order[edge[g] : edge[g + 1]]
            for x, y in tile_pairs(fp[at], radius):
                forest.add(at[x], at[y])
    root = forest.settle()
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def near_edges(distinct: DataFrame, radius: int, agree: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of (id, hi, lo) within the radius.

    A pair is compared in the bucket of its first equal block, one task each,
    with one bucket in memory at a time.
    """
    blocks = block_bounds(radius + agree)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = block_values(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1).view(U64), blocks)
            for k in range(radius + 1):  # of agree equal blocks the first is one of these
                bucket = (np.int32(k) << np.int32(16)) | values[k].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "id", "hi", "lo"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, hi, lo = (table[x].to_numpy() for x in ("id", "hi", "lo"))
        x, y = bucket_edges(ids, np.stack([hi, lo], 1).view(U64), key[0].as_py() >> 16, radius, agree)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return distinct.select("id", "hi", "lo").mapInArrow(spread, "bucket int, id long, hi long, lo long").groupBy("bucket").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, agree: int | None = None) -> DataFrame:
    """(doc_id, group_id, kept): every document with the least id of its group of near copies.

    Two texts are near copies if their fingerprints differ in at most
    ``radius`` of 128 bits; a group is a connected component of that relation,
    and the document with the least id stays.

    Null, empty and wordless texts are alone in their group; a very long text
    counts with all its words.  Rows without an id have a null group and stay.
    Rows that repeat an id share one decision (that of their least-id near
    copy).  A tie of bits counts as 0.  Other columns, whatever their names,
    are not read.  An empty table gives an empty result.
    """
    fps = checkpoint(fingerprint_table(docs, id_col, text_col))
    distinct = checkpoint(fps.groupBy("hi", "lo").agg(F.min("id").alias("id")))
    if agree is None:
        agree = choose_agree(distinct.count(), radius)
    exact = fps.join(distinct.withColumnRenamed("id", "first"), ["hi", "lo"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    root = components(near_edges(distinct, radius, agree).unionByName(exact), "a", "b")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(root, ids.doc_id == root.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), (F.col("root").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents that stay, with the columns that came; see near_duplicates()."""
    return without(docs, id_col, near_duplicates(docs, id_col, text_col, radius).where(~F.col("kept")).select("doc_id"))

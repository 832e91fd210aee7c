"""Repeated passages by difference-cover anchors.

Positions are words (runs between ASCII white space, case kept).  With a cover
D of period v, any two positions i and j have a k < v such that both i + k and
j + k are cover positions.  So windows of w words are hashed at cover positions
only, and any two equal passages of at least L = w + v - 1 words share an
aligned anchor.  Anchors that occur once go; around the others the windows of
L words are hashed, and equal ones are the repeated passages, whose union is
the exact extension of each anchor.

Anchors travel as packed arrays, one row a gathering of texts and bucket of
hashes, so that Spark moves and sorts thousands of rows, not billions.  Of
windows that are equal within a gathering only the first one travels to the
bucket of its hash; the others are known to repeat.  So a passage that every
document has is one entry a gathering there, not one an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .texthash import U64, Windows, window_starts, words

LEAST_WORDS = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Windows that a task gathers before it sends them on.
GATHER = 1 << 20
_BLOB = "bucket int, hashes binary, docs binary, places binary"


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Whether every difference modulo the period is one of two cover positions."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _blobs(h: np.ndarray, doc: np.ndarray, place: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """One row a bucket, that is the leading bits of the hash."""
    if not len(h):
        return None
    bucket = (h >> U64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, h, doc, place = bucket[order], h[order], doc[order].astype(np.int64), place[order].astype(np.int32)
    edge = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(bucket)]])

    def cut(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), cut(h), cut(doc), cut(place)], names=["bucket", "hashes", "docs", "places"])


def _ordered(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers by hash, document and place, each such triple once; is the first of its hash; the hash has more than one)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = np.zeros(len(s), bool)
    twin[1:] |= s[1:] == s[:-1]
    twin[:-1] |= s[1:] == s[:-1]
    among = order[twin]  # the others need no further order
    among = among[np.lexsort((place[among], doc[among], h[among]))]
    order[twin] = among
    s, d, p = h[order], doc[order], place[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    order, s = order[new], s[new]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    more = ~first
    more[:-1] |= ~first[1:]
    return order, first, more


class Gathering:
    """Windows of a task: those that are the first of their hash go to a bucket, the others repeat for sure."""

    def __init__(self, bits: int, limit: int = GATHER):
        self.bits, self.limit = bits, limit
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(h), self.limit):
            part = slice(lo, lo + self.limit)
            self.parts.append((h[part], doc[part].astype(np.int64), place[part].astype(np.int32)))
            self.many += len(h[part])
            if self.many >= self.limit:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.many:
            return
        h, doc, place = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.many = [], 0
        order, first, more = _ordered(h, doc, place)
        head, rest = order[first], order[~first]
        coded = np.zeros(len(h), np.int32)
        coded[head] = place[head] << 1 | more[first]  # whether the hash is known to repeat
        head.sort()  # in the order of the texts, which packs well
        yield _blobs(h[head], doc[head], coded[head], self.bits)
        for lo in range(0, len(rest), 1 << 16):
            part = rest[lo : lo + (1 << 16)]
            part = part[np.lexsort((place[part], doc[part]))]
            bucket = -1 - int(h[part[0]] >> U64(64 - self.bits))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([b""], pa.binary()), pa.array([doc[part].tobytes()], pa.binary()), pa.array([place[part].tobytes()], pa.binary())], names=["bucket", "hashes", "docs", "places"])


def _settled(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch | None:
    """The repeated windows among those of one bucket, by document."""
    h, doc, coded = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((1, U64), (2, np.int64), (3, np.int32)))
    if rows[0][0] < 0:  # all repeat, and none is the first of its kind
        return _by_doc(doc, coded, np.zeros(len(doc), np.int32))
    place = coded >> 1
    order, first, more = _ordered(h, doc, place)
    if not len(order):
        return None
    known = np.unique(h[(coded & 1) == 1])
    more |= np.isin(h[order], known)
    return _by_doc(doc[order][more], place[order][more], first[more].astype(np.int32))


def _by_doc(doc: np.ndarray, place: np.ndarray, flag: np.ndarray) -> pa.RecordBatch | None:
    """One row a document: its places, and which of them are the first of their kind."""
    if not len(doc):
        return None
    order = np.lexsort((place, doc))
    doc, place, flag = doc[order], place[order], flag[order]
    edge = np.concatenate([np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), [len(doc)]]).astype(np.int32)
    coded = (place.astype(np.int32) << 1) | flag
    return pa.RecordBatch.from_arrays([pa.array(doc[edge[:-1]]), pa.ListArray.from_arrays(pa.array(edge), pa.array(coded))], names=["doc_id", "places"])


def anchor_windows(first: np.ndarray, width: int, cover: tuple[int, ...], period: int) -> np.ndarray:
    """Word indexes of the cover windows of every text, counted from the text's first word."""
    at = window_starts(first, width)
    if not len(at):
        return at
    within = at - np.repeat(first[:-1], np.maximum(np.diff(first) - width + 1, 0))
    member = np.zeros(period, bool)
    member[list(cover)] = True
    return at[member[within % period]]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, cover: tuple[int, ...] = COVER, period: int = PERIOD) -> DataFrame:
    """(doc_id, first_word, end_word, removable): the stretches of each document whose every window of
    ``least_words`` words also occurs elsewhere, in another document or further on in the same one.

    ``removable`` stretches are unions of windows that occur earlier, in the
    order of document id and place; the others are unions of windows that are
    the first of their kind.  Cutting the removable ones leaves one copy of
    every passage.

    Null ids, null and empty texts, and texts of fewer words, have no row; a
    very long text is compared whole, with itself too.  Rows that repeat an id
    and text count once.  Ties have the order of id and place.  Other columns,
    whatever their names, are not read.  An empty table gives no row.  Equal
    windows are told by 64-bit hashes.
    """
    width = least_words - period + 1
    if width < 1 or not is_cover(cover, period):
        raise ValueError("the cover must have all differences modulo its period, and the least length exceed the period")
    spark = docs.sparkSession
    bits = max(10, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathering = Gathering(bits)
        for batch in batches:
            for part in slices(batch, 1, 6 << 20):
                ids = part.column(0).to_numpy()
                found = words(part.column(1).to_pylist(), lower=False)
                at = anchor_windows(found.first, width, cover, period)
                doc = np.searchsorted(found.first, at, "right") - 1
                yield from gathering.add(Windows(found.hashes).at(at, width), ids[doc], at - found.first[doc])
        yield from gathering.send()

    def twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, bytes, bytes]] = []
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), *(c.to_pylist() for c in batch.columns[1:])):
                if rows and rows[0][0] != row[0]:
                    if made := _settled(rows):
                        yield made
                    rows = []
                rows.append(row)
        if rows and (made := _settled(rows)):
            yield made

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathering = Gathering(bits)
        for batch in batches:
            for part in slices(batch, 1, 6 << 20):
                ids = part.column(0).to_numpy()
                found = words(part.column(1).to_pylist(), lower=False)
                lists = part.column(2)
                count = np.diff(lists.offsets.to_numpy())
                place = (lists.flatten().to_numpy() >> 1).astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), count)
                at = found.first[doc] + place
                lo = np.maximum(found.first[doc], at + width - least_words)
                hi = np.minimum(at, found.first[doc + 1] - least_words)  # the last start, inclusive
                some = hi >= lo
                step = np.zeros(len(found.hashes) + 1, np.int32)
                np.add.at(step, lo[some], 1)
                np.add.at(step, hi[some] + 1, -1)
                start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                doc = np.searchsorted(found.first, start, "right") - 1
                yield from gathering.add(Windows(found.hashes).at(start, least_words), ids[doc], start - found.first[doc])
        yield from gathering.send()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            first, place = coded & 1, (coded >> 1).astype(np.int64)
            order = np.lexsort((place, first, row))
            row, first, place = row[order], first[order], place[order]
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1]) | (place[1:] > place[:-1] + least_words)
            lo = np.flatnonzero(new)
            hi = np.concatenate([lo[1:], [len(row)]]) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[lo])), pa.array(place[lo]), pa.array(place[hi] + least_words), pa.array(first[lo] == 0)], names=["doc_id", "first_word", "end_word", "removable"])

    by_doc = "doc_id long, places array<int>"
    merged = F.flatten(F.collect_list("places")).alias("places")

    def repeated(blobs: DataFrame) -> DataFrame:
        return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(twins, by_doc).groupBy("doc_id").agg(merged)

    candidate = repeated(source.mapInArrow(anchors, _BLOB))
    window = source.join(candidate, "doc_id").select("doc_id", "text", "places").mapInArrow(extended, _BLOB)
    return repeated(window).mapInArrow(spans, "doc_id long, first_word long, end_word long, removable boolean")

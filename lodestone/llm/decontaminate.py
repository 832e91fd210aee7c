"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item of n words if some stretch of it is within
k = floor(rate * n) word edits of the item; words are compared in lower case.

The search:

1. Item-sized windows and the item are embedded by the random walk of
   Chakraborty, Goldenberg and Koucky (2016), which maps edit distance to
   Hamming distance.  A table samples ``samples`` coordinates; a window is a
   candidate if it agrees with the item in any of ``tables`` tables.  By
   tables_needed(), 24 tables reach a recall of 0.9 where a table agrees with
   a chance of 0.092; at the greatest edit rate allowed it is measured higher
   (tests/llm/test_search_ops.py).
2. The exact least edit distance between the item and any part of the
   candidate's neighbourhood decides (Myers' bit-parallel recurrence).

Of all windows only those are embedded that can be a leak at all: of the
item's words, cut into k + 1 runs, one run occurs unchanged in a leak, so a
window that shares no run of q = floor(n / (k + 1)) words with the item,
within k places of the same offset, is none.  Nothing is lost by it, and
``every_window`` searches without it, which gives no leak more that passes
the exact test than the tables' chance does (see the tests).
"""

from __future__ import annotations

import math
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, without
from .texthash import U64, Windows, mix, window_starts, words

RATE = 0.2
TABLES = 24
SAMPLES = 2
#: Benchmark text that one pass over the documents holds in each worker; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
_PAD = U64(0x243F6A8885A308D3)


def edits_allowed(n: int, rate: float = RATE) -> int:
    return int(rate * n + 1e-9)


def run_length(n: int, rate: float = RATE) -> int:
    """Words of which some run occurs unchanged in anything within the allowed edits."""
    return n // (edits_allowed(n, rate) + 1)


@lru_cache(maxsize=256)
def walk_plan(n: int, table: int, samples: int = SAMPLES) -> tuple[tuple[int, ...], np.ndarray]:
    """(sampled coordinates in ascending order, the odd factor of each step's coin) for items of n words."""
    rng = np.random.Generator(np.random.PCG64([n, table, 16]))
    coordinates = tuple(sorted(rng.integers(0, 3 * n // 2 + 1, samples).tolist()))
    return coordinates, rng.integers(0, 2**63, coordinates[-1] + 1, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def walk_key(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int, table: int, samples: int = SAMPLES) -> np.ndarray:
    """The bucket of each window hashes[starts:stops] in a table.

    Step j of the walk emits the current word and goes on to the next one if
    step j's coin for that word says so; the key is made of the words emitted
    at the sampled coordinates.
    """
    coordinates, factor = walk_plan(n, table, samples)
    at = starts.copy()
    key = np.full(len(starts), U64(table + 1), U64)
    last = len(hashes) - 1
    for j in range(coordinates[-1] + 1):
        word = np.where(at < stops, hashes[np.minimum(at, last)], _PAD)
        for _ in range(coordinates.count(j)):
            key = mix(key ^ word)
        at = at + ((word * factor[j]) >> U64(63)).astype(np.int64)
    return key


def least_edits(item: list[int], text: list[int]) -> int:
    """The least edit distance between ``item`` and any contiguous part of ``text``."""
    n = len(item)
    if not n:
        return 0
    peq: dict[int, int] = {}
    for k, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best = n
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1  # free start: no carry comes in
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best = score
    return best


class Items:
    """Benchmark items as word hashes, with their runs and their buckets in every table."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE, tables: int = TABLES, samples: int = SAMPLES):
        self.rate, self.tables, self.samples = rate, tables, samples
        found = words([t for _, t in rows])
        sizes = np.diff(found.first)
        keep = np.flatnonzero(sizes > 0)
        self.ids = [rows[k][0] for k in keep]
        self.n = sizes[keep]
        self.hashes, self.first = found.hashes, found.first[keep]
        self.words = [found.hashes[a : a + n].tolist() for a, n in zip(self.first, self.n)]
        self.edits = np.array([edits_allowed(int(n), rate) for n in self.n], np.int64)
        window = Windows(self.hashes)
        self.runs = {}  # run length -> (sorted hash, item, offset in the item), and a bitmap of the hashes' low bits
        by_q: dict[int, list[int]] = {}
        for k, n in enumerate(self.n):
            by_q.setdefault(run_length(int(n), rate), []).append(k)
        for q, members in by_q.items():
            item = np.concatenate([np.full(self.n[k] - q + 1, k) for k in members])
            offset = np.concatenate([np.arange(self.n[k] - q + 1) for k in members])
            h = window.at(self.first[item] + offset, q)
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << 22, bool)
            bitmap[h & U64((1 << 22) - 1)] = True
            self.runs[q] = (h[order], item[order], offset[order], bitmap)
        self.keys = np.stack([self._key(t) for t in range(tables)], 1) if len(keep) else np.zeros((0, tables), U64)

    def _key(self, table: int) -> np.ndarray:
        out = np.zeros(len(self.n), U64)
        for n in np.unique(self.n):
            k = np.flatnonzero(self.n == n)
            out[k] = walk_key(self.hashes, self.first[k], self.first[k] + n, int(n), table, self.samples)
        return out


def windows_to_embed(hashes: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, start word) of every window that can be within the item's edits; the starts are over the whole batch."""
    window = Windows(hashes)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for q, (h, item, offset, bitmap) in items.runs.items():
        at = window_starts(first, q)
        if not len(at):
            continue
        g = window.at(at, q)
        hit = np.flatnonzero(bitmap[g & U64((1 << 22) - 1)])
        lo, hi = np.searchsorted(h, g[hit], "left"), np.searchsorted(h, g[hit], "right")
        many = hi - lo
        entry = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place = np.repeat(at[hit], many)
        i = item[entry]
        base = place - offset[entry]
        reach = items.edits[i]
        span = 2 * reach + 1
        shift = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span + reach, span)
        start = np.repeat(base, span) + shift
        doc = np.repeat(owner[place], span)
        i = np.repeat(i, span)
        ok = (start >= first[doc]) & (start < first[doc + 1])
        # an item's head may be missing at the document's start
        clipped = np.maximum(start[~ok], first[doc[~ok]])
        inside = clipped < first[doc[~ok] + 1]
        found.append(np.stack([np.concatenate([i[ok], i[~ok][inside]]), np.concatenate([start[ok], clipped[inside]])], 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.concatenate(found)
    key = np.unique(pairs[:, 0].astype(np.int64) * (len(hashes) + 1) + pairs[:, 1])
    return key // (len(hashes) + 1), key % (len(hashes) + 1)


def tables_needed(recall: float, agreement: float) -> int:
    """Tables that find a leak with the given chance if each agrees with ``agreement``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement))


def every_window(hashes: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, start word) of every item-sized window of every text and each item of that size."""
    at = window_starts(first, 1)
    pairs = [(np.repeat(np.flatnonzero(items.n == n), len(at)), np.tile(at, int((items.n == n).sum()))) for n in np.unique(items.n)]
    return (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def candidates(hashes: np.ndarray, first: np.ndarray, items: Items, windows=windows_to_embed) -> tuple[np.ndarray, np.ndarray]:
    """The windows that share a bucket with their item."""
    item, start = windows(hashes, first, items)
    if not len(item):
        return item, start
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = np.minimum(start + items.n[item], first[owner[start] + 1])
    hit = np.zeros(len(item), bool)
    for n in np.unique(items.n[item]):
        k = np.flatnonzero(items.n[item] == n)
        for t in range(items.tables):
            k = k[~hit[k]]
            if not len(k):
                break
            hit[k] = walk_key(hashes, start[k], stop[k], int(n), t, items.samples) == items.keys[item[k], t]
    return item[hit], start[hit]


def leaks(texts: list[str | None], items: Items, windows=windows_to_embed) -> list[tuple[int, int, int]]:
    """(text, item, least edits) of each leak found."""
    found = words(texts)
    item, start = candidates(found.hashes, found.first, items, windows)
    owner = found.owner()
    best: dict[tuple[int, int], int] = {}
    region: tuple[int, int, int, int] | None = None

    def settle() -> None:
        doc, i, lo, hi = region
        edits = least_edits(items.words[i], found.hashes[lo:hi].tolist())
        if edits <= items.edits[i]:
            best[doc, i] = min(edits, best.get((doc, i), edits))

    for i, s in zip(item.tolist(), start.tolist()):  # in the order of item and start, so that overlapping windows follow each other
        doc, k, n = int(owner[s]), int(items.edits[i]), int(items.n[i])
        lo, hi = max(s - k, int(found.first[doc])), min(s + n + k, int(found.first[doc + 1]))
        if region and region[:2] == (doc, i) and lo <= region[3]:
            region = (doc, i, region[2], max(hi, region[3]))
            continue
        if region:
            settle()
        region = (doc, i, lo, hi)
    if region:
        settle()
    return sorted((doc, i, edits) for (doc, i), edits in best.items())


_BUILT: dict[tuple, Items] = {}


def _built(token: tuple, rows: list, rate: float, tables: int, samples: int) -> Items:
    """The items of the current pass, kept by each worker process."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Items(rows, rate, tables, samples)
    return _BUILT[token]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, tables: int = TABLES, samples: int = SAMPLES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, edits): each document with each item it leaks, and the least edits found.

    The documents are read in place, without a shuffle.  The benchmark is
    measured first; what exceeds ``pass_bytes`` is split by a hash of the item
    over several passes, so no worker ever holds more.

    Null, empty or wordless texts and items leak nothing; a very long text is
    searched whole; an item of one word is in every text with that word.  A
    null document id is kept as null; repeated documents each give their rows,
    repeated items are one, and every item found has its row, so there are no
    ties.  Other columns, whatever their names, are not read.  An empty table
    on either side gives no row.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("body")).where("item is not null and body is not null").distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    out = None
    for p in range(passes):
        part = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == p)
        sent = spark.sparkContext.broadcast(sorted((r.item, r.body) for r in part.collect()))
        token = (uuid4().hex, rate, tables, samples)

        def work(ids: pa.Array, texts: list, sent=sent, token=token) -> dict | None:
            items = _built(token, sent.value, rate, tables, samples)
            got = leaks(texts, items)
            if not got:
                return None
            doc, item, edits = map(list, zip(*got))
            return {"doc_id": ids.take(pa.array(doc)), "item_id": [items.ids[k] for k in item], "item_words": [int(items.n[k]) for k in item], "edits": edits}

        made = map_texts(docs, id_col, text_col, work, "doc_id long, item_id long, item_words long, edits long", limit=6 << 20)
        out = made if out is None else out.unionByName(made)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item, with the columns that came; rows without an id stay."""
    return without(docs, id_col, contaminated(docs, benchmark, id_col, text_col, **options).select("doc_id"))

"""Tagged memory, response caches, fingerprints and limits, as keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import checkpoint

MEMORY = "key string, value string, tags array<string>, token_count int, size_bytes long, stored_at timestamp"


def entry(value: Column) -> list[Column]:
    return [T.estimate_tokens(value).cast("int").alias("token_count"), F.octet_length(value).cast("long").alias("size_bytes")]


def latest(log: DataFrame) -> DataFrame:
    """One row a key: the last stored; of equal times the greatest value."""
    w = Window.partitionBy("key").orderBy(F.desc("stored_at"), F.desc("value"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    return latest(memory.unionByName(new))


def by_tags(memory: DataFrame, tags: list[str]) -> DataFrame:
    """Entries with any of the tags."""
    return memory.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def tag_index(memory: DataFrame) -> DataFrame:
    return memory.select("key", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n_keys"))


def recall(memory: DataFrame, key: str | None = None, tags: list[str] | None = None, part: str | None = None, preview: int = 200) -> DataFrame:
    """By key, else by tags, else by a part of the value in any case, else all; values are cut to a preview unless by key."""
    if key is not None:
        return memory.where(F.col("key") == key).select("key", "value", "tags")
    found = by_tags(memory, tags) if tags else memory.where(F.lower("value").contains(part.lower())) if part else memory
    return found.select("key", F.substring("value", 1, preview).alias("value"), "tags")


def list_entries(memory: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return memory.orderBy(F.desc("stored_at"), "key").offset(offset).limit(limit)


def delete(memory: DataFrame, keys: list[str]) -> DataFrame:
    return memory.where(~F.col("key").isin(*keys))


def evict_oldest(memory: DataFrame, most: int = 10_000, drop: int = 100) -> DataFrame:
    """With ``most`` entries or more, the ``drop`` oldest go (of equal times the least keys)."""
    oldest = memory.orderBy("stored_at", "key").limit(drop).select("key")
    full = memory.agg((F.count("*") >= most).alias("_full"))
    gone = oldest.join(full).where("_full").select("key")
    return memory.join(gone, "key", "left_anti")


def evict_by_size(memory: DataFrame, to_free: int) -> DataFrame:
    """Oldest first until ``to_free`` bytes are free; the last one may free more.

    The running sum is two-level, within an hour and over the hours' sums, so
    no task sorts the whole memory.
    """
    hours = memory.withColumn("_hour", F.floor(_micros(F.col("stored_at")) / 3_600_000_000))
    before = Window.unboundedPreceding
    base = hours.groupBy("_hour").agg(F.sum("size_bytes").alias("_sum")).select(F.col("_hour").alias("_h"), F.coalesce(F.sum("_sum").over(Window.orderBy("_hour").rowsBetween(before, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("size_bytes").over(Window.partitionBy("_hour").orderBy("stored_at", "key").rowsBetween(before, -1)), F.lit(0))
    placed = hours.withColumn("_inner", inner).join(base, F.col("_hour").eqNullSafe(F.col("_h")))
    return placed.where(F.col("_base") + F.col("_inner") >= to_free).select(*memory.columns)


def memory_stats(memory: DataFrame) -> DataFrame:
    tags = memory.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("n_tags"))
    return memory.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.min("stored_at").alias("oldest"), F.max("stored_at").alias("newest")).join(tags)


def _micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone (read as the session's, UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def not_expired(cache: DataFrame, now: Column, ttl_seconds: int, inclusive: bool = True) -> DataFrame:
    """Entries whose age is at most the limit, or below it."""
    age = _micros(now) - _micros(F.col("ts"))
    limit = ttl_seconds * 1_000_000
    return cache.where(age <= limit if inclusive else age < limit)


def _most_similar(scored: DataFrame, *by: str) -> DataFrame:
    """Of each query's (key, similarity) the most similar, of equals the least key; keys of any type that has an order."""
    by = by or ("query_id",)
    order = F.when(F.isnan("similarity"), float("-inf")).otherwise(-F.col("similarity"))  # NaN is greater than any number
    best = F.min_by(F.struct("key", "similarity"), F.struct(order, F.col("key")))
    return scored.groupBy(*by).agg(best.alias("b")).select(*by, "b.key", "b.similarity")


#: Bytes of cached vectors, and of queries, that a cell holds at most; more take more cells.
VECTOR_BYTES = 16 << 20
#: Bytes of cached vectors that are worth a cell of their own while there are fewer cells than cores have room for.
SMALL_CELL = 256 << 10


def nearest_by_vector(queries: DataFrame, cache: DataFrame, least: float = 0.85, pass_bytes: int = VECTOR_BYTES) -> DataFrame:
    """(query_id, key, similarity): the most similar cached vector, of equals the least key, if it reaches ``least``.

    All pairs are compared, as products of numpy matrices.  Both sides are
    measured and cut by hashes into parts of about ``pass_bytes`` at most; a
    cell is a part of the queries beside a part of the cache, and cells are
    spread over the cluster, so neither the driver nor a worker holds a side.
    Vectors of another length or of norm 0 have similarity 0; null vectors and
    keys have none.  Similarities are rounded to 12 digits, so that equal
    vectors tie.
    """
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    kept = cache.where("key is not null and embedding is not null").select("key", vector)
    asked = queries.where("embedding is not null").select("query_id", vector)
    n_bytes = F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0)).cast("long")
    held_bytes, asked_bytes = (df.agg(n_bytes).first()[0] for df in (kept, asked))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-held_bytes // pass_bytes), min(2 * cores, held_bytes // SMALL_CELL))
    rows = max(1, -(-asked_bytes // pass_bytes))
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, key {dict(cache.dtypes)['key']}, similarity double"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda name, n: F.pmod(F.xxhash64(name, "embedding"), F.lit(n)).cast("int")  # noqa: E731  # ids may repeat
    cell = (F.col("_row") * parts + F.col("_part")).alias("cell")
    left = asked.withColumn("_row", part("query_id", rows)).withColumn("_part", every(parts)).select(cell, "query_id", "embedding")
    right = kept.withColumn("_part", part("key", parts)).withColumn("_row", every(rows)).select(cell, "key", "embedding")

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        held = held.sort_values("key", kind="stable")
        by_size = {k: rows for k, rows in held.groupby(held.embedding.map(len))}
        for k, rows in asked.groupby(asked.embedding.map(len)):
            others = [kept.key.iloc[0] for j, kept in by_size.items() if j != k]  # of similarity 0
            if others:
                found += [(query, min(others), 0.0) for query in rows.query_id]
            if k in by_size:
                found += _best(_unit(_matrix(rows, k))[0], _unit(_matrix(by_size[k], k))[0], rows.query_id, by_size[k].key)
        return pd.DataFrame(found, columns=["query_id", "key", "similarity"])

    cells = lambda df: df.repartition(rows * parts, "cell").groupBy("cell")  # noqa: E731  # a number that is given is not coalesced
    made = cells(left).cogroup(cells(right)).applyInPandas(run, kinds)
    return _most_similar(made.where(F.col("similarity") >= least))


def _matrix(rows: pd.DataFrame, k: int) -> np.ndarray:
    return np.array(rows.embedding.tolist(), np.float64).reshape(len(rows), k)


def _best(asked: np.ndarray, held: np.ndarray, queries: pd.Series, keys: pd.Series, tile: int = 4096) -> list[tuple]:
    """(query, key, similarity) of the greatest product of each row, rounded to 12 digits, of equals the first; in tiles of bounded size."""
    found = []
    for lo in range(0, len(asked), 256):
        block = asked[lo : lo + 256]
        best, at = np.full(len(block), -np.inf), np.zeros(len(block), np.int64)
        for first in range(0, len(held), tile):
            scores = block @ held[first : first + tile].T
            top = scores.max(axis=1)
            if np.isnan(top).any():
                scores = np.where(np.isnan(scores), np.inf, scores)  # greater than any number, as in a sort
                top = scores.max(axis=1)
            x, y = np.nonzero(scores >= (top - 2e-12)[:, None])  # what may be equal once it is rounded
            value = np.round(scores[x, y], 12)
            order = np.lexsort((y, -value, x))
            x, y, value = x[order], y[order], value[order]
            head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            x, y, value = x[head], y[head], value[head]
            more = value > best[x]  # of equal tiles the first
            best[x[more]], at[x[more]] = value[more], first + y[more]
        best = np.where(np.isinf(best), np.nan, best)
        found += zip(queries.iloc[lo : lo + 256], keys.iloc[at], best.tolist())
    return found


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of norm 1 (or 0), and their norms."""
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1.0), norm


#: Counters of words; with fewer than there are words some share one, which costs order and no pair.
WORD_SLOTS = 1 << 20
#: Words that are put in order at a time.
WORDS_AT_ONCE = 1 << 20


def _rarity(sets: DataFrame) -> np.ndarray:
    """The place of each slot of word hashes when the rarest come first; what is collected does not grow with the table."""
    slot = F.pmod(F.xxhash64("word"), F.lit(WORD_SLOTS)).cast("int").alias("slot")
    got = sets.select(F.explode("w").alias("word")).select(slot).groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    count, place = np.zeros(WORD_SLOTS, np.int64), np.empty(WORD_SLOTS, np.int32)
    count[got["slot"].to_numpy()] = got["n"].to_numpy()
    place[np.argsort(count, kind="stable")] = np.arange(WORD_SLOTS, dtype=np.int32)
    return place


def _prefixes(sets: DataFrame, place: Broadcast, least: float) -> DataFrame:
    """(word, s, n, r, b0 to b3): the hashes of the first n - ceil(least * n) + 1 words of each set, the rarest first, with their places and 256 parities of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(1).value_lengths(), np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS_AT_ONCE, "right")))
                yield cut(batch.slice(lo, hi - lo))
                lo = hi

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, words = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
        n = np.asarray(batch.column(1).value_lengths(), np.int64)
        start = np.cumsum(n) - n
        bit = np.left_shift(np.uint64(1), ((words >> 20) & 63).astype(np.uint64))
        parity = [np.bitwise_xor.reduceat(np.where((words >> 26) & 3 == k, bit, np.uint64(0)), start).view(np.int64) for k in range(4)]
        owner = np.repeat(np.arange(len(n)), n)
        words = words[np.lexsort((words, place.value[words & (WORD_SLOTS - 1)], owner))]
        r = np.arange(len(words)) - start[owner]
        kept = np.flatnonzero(r <= (n - np.ceil(n * least - 1e-9))[owner])
        of = owner[kept]
        columns = [words[kept], s[of], n[of].astype(np.int32), r[kept].astype(np.int32), *(b[of] for b in parity)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "s", "n", "r", "b0", "b1", "b2", "b3"])

    return sets.select("s", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).mapInArrow(run, "word long, s long, n int, r int, b0 long, b1 long, b2 long, b3 long")


def nearest_by_words(queries: DataFrame, cache: DataFrame, least: float = 0.7) -> DataFrame:
    """(query_id, key, similarity): the cached text with the greatest Jaccard similarity of words, of equals the least key.

    Equal sets join as they are, and of a set that many texts have one is
    compared.  Two other sets of that similarity share a word among the first
    n - ceil(least * n) + 1 of each, in any common order; here the rarest
    come first.  At the first word that they share, enough words must follow
    in both, and the parities of their words' hashes may differ in no more
    places than the sets may differ in words.  So hardly any pair but the
    wanted ones is left when the sets themselves join.
    """
    t = max(least, 0.0)
    w = F.sort_array(T.word_set(F.col("text"))).alias("w")
    texts = queries.select("query_id", w).unionByName(cache.select("key", w), allowMissingColumns=True)  # ids of the two sides may differ in type
    sets = checkpoint(texts.groupBy("w").agg(F.min("key").alias("key"), F.collect_list("query_id").alias("query_id"))).where(F.size("w") >= 2).withColumn("s", F.xxhash64("w"))
    held, asked = sets.where("key is not null"), sets.where("key is null and size(query_id) > 0")
    place = queries.sparkSession.sparkContext.broadcast(_rarity(sets))
    left, right = _prefixes(asked, place, t), _prefixes(held, place, t).toDF("word", "_s", "m", "_r", "c0", "c1", "c2", "c3")
    both = F.col("n") + F.col("m")
    sizes = (F.col("m") >= F.col("n") * t - 1e-9) & (F.col("n") >= F.col("m") * t - 1e-9)
    follow = F.least(F.col("n") - F.col("r"), F.col("m") - F.col("_r")) >= both * (t / (1 + t)) - 1e-9
    differ = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"c{k}"))) for k in range(4)), F.lit(0)) <= both * ((1 - t) / (1 + t)) + 1e-9
    pairs = left.join(right, (left["word"] == right["word"]) & sizes & follow & differ).select("s", "_s").distinct()
    scored = pairs.join(asked, "s").drop("key").join(held.select(F.col("s").alias("_s"), F.col("w").alias("v"), "key"), "_s").select("s", "w", "key", T.jaccard(F.col("w"), F.col("v")).alias("similarity"))
    near = _most_similar(scored.where(F.col("similarity") >= least), "s", "w").join(asked.drop("key"), ["s", "w"])
    found = held.withColumn("similarity", F.lit(1.0)).unionByName(near, allowMissingColumns=True).select(F.explode("query_id").alias("query_id"), "key", "similarity")
    return _most_similar(found.where(F.col("similarity") >= least))


def cache_put(cache: DataFrame, new: DataFrame, most: int = 1000) -> DataFrame:
    """A response cache (key, ts and more) with new entries: the last of a key stays, and of those the ``most`` youngest (of equal times the greatest keys)."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"))
    last = cache.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return last.orderBy(F.desc("ts"), F.desc("key")).limit(most)


def cache_load(spark: SparkSession, path: str, now: Column, ttl_seconds: int, most: int = 1000) -> DataFrame:
    """The entries of a stored cache that are still valid, the ``most`` youngest."""
    return not_expired(spark.read.parquet(path), now, ttl_seconds, inclusive=False).orderBy(F.desc("ts"), F.desc("key")).limit(most)


def clear(memory: DataFrame) -> DataFrame:
    return memory.where(F.lit(False))


def reuse_stats(files: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: files, hits (fingerprint as cached), changed, new, and hit_rate; cache has path and content_hash."""
    now = fingerprints(files)
    before = cache.select("path", F.col("content_hash").alias("_old")).groupBy("path").agg(F.collect_set("_old").alias("_old"))
    j = now.join(before, "path", "left")
    hit = F.coalesce(F.array_contains("_old", F.col("content_hash")), F.lit(False))
    out = j.agg(F.count("*").alias("files"), F.count_if(hit).alias("hits"), F.count_if(~hit & F.col("_old").isNotNull()).alias("changed"), F.count_if(F.col("_old").isNull()).alias("new"))
    return out.withColumn("hit_rate", F.when(F.col("files") > 0, F.round(F.col("hits") / F.col("files"), 6)).otherwise(0.0))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("content_hash"), "size_bytes")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Fingerprints that are new or differ."""
    return now.join(before.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def unchanged_files(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(before.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def cached_analyses(files: DataFrame, cache: DataFrame, query: str) -> DataFrame:
    """(path, result): cached results of the same query for files whose fingerprint still holds; null is a miss."""
    wanted = cache.where(F.col("query_hash") == F.substring(F.sha2(F.lit(query), 256), 1, 16)).select("path", "content_hash", "result")
    return fingerprints(files).join(wanted, ["path", "content_hash"], "left").select("path", "result")


def rate_limit(requests: DataFrame, key: str = "user_id", per_minute: int = 60) -> DataFrame:
    """Requests with ``recent``, the number of the key's requests in the 60 seconds up to and with each, and ``allowed``."""
    w = Window.partitionBy(key).orderBy(_micros(F.col("ts"))).rangeBetween(-59_999_999, 0)
    return requests.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= per_minute)


def breaker(calls: DataFrame, key: str, failures: int = 5, cool_seconds: int = 60) -> DataFrame:
    """(key, n_calls, n_refused, open_at_end): a circuit breaker folded over each key's calls in time order.

    It opens after ``failures`` failures in a row and lets a call through
    again ``cool_seconds`` after the last one; a success closes it.
    """
    ordered = calls.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id", "failed"))).alias("calls"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("last"), F.lit(0).alias("refused"))

    def step(a: Column, c: Column) -> Column:
        shut = (a["run"] >= failures) & (c["t"] - a["last"] < cool_seconds)
        return F.struct(
            F.when(shut, a["run"]).when(c["failed"], a["run"] + 1).otherwise(0).alias("run"),
            F.when(~shut & c["failed"], c["t"]).otherwise(a["last"]).alias("last"),
            (a["refused"] + shut.cast("int")).alias("refused"),
        )

    return ordered.select(key, F.size("calls").alias("n_calls"), F.aggregate("calls", start, step).alias("s")).select(key, "n_calls", F.col("s.refused").alias("n_refused"), (F.col("s.run") >= failures).alias("open_at_end"))

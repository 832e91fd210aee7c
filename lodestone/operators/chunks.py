"""Chunking: fixed windows, greedy packing, markdown, sentences, functions, and the cascade."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 32_000
OVERLAP = 500


def fixed_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(path, chunk_id, start, content): windows of ``size`` characters, each ``size - overlap`` after the one before; '' has none."""
    step = size - overlap
    starts = F.when(F.length("content") > 0, F.sequence(F.lit(0), F.length("content") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return files.select("file_seq", "path", "content", F.posexplode(starts).alias("chunk_id", "start")).select("file_seq", "path", "chunk_id", "start", F.substring(F.col("content"), F.col("start") + 1, F.lit(size)).alias("content"))


def token_chunks(files: DataFrame, tokens: int = 8000, overlap: int = 200) -> DataFrame:
    """Fixed windows in estimated tokens (four characters each)."""
    return fixed_chunks(files, 4 * tokens, 4 * overlap)


def pack(parts: Column, limit: int, separator: str = "\n\n") -> Column:
    """array<string> packed greedily in order: a part that would exceed ``limit`` characters starts the next pack.

    A part over the limit is a pack of its own.  Empty parts are left out.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(separator), part))
        flush = (acc["open"] != "") & (F.length(joined) > limit)
        return F.struct(F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(flush, part).otherwise(joined).alias("open"))

    return F.aggregate(F.filter(parts, lambda p: p != ""), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def _exploded(files: DataFrame, chunks: Column) -> DataFrame:
    return files.select("file_seq", "path", F.posexplode(chunks).alias("chunk_id", "content")).withColumn("token_count", F.floor(F.length("content") / 4).cast("int"))


def paragraph_chunks(files: DataFrame, limit: int = SIZE) -> DataFrame:
    return _exploded(files, pack(F.split("content", r"\n\s*\n", -1), limit))


def sentence_chunks(files: DataFrame, limit: int = SIZE) -> DataFrame:
    """Sentences end at '.', '!' or '?'; a text without any is one part, and a trailing fragment is kept."""
    parts = F.regexp_extract_all("content", F.lit(r"(?s)([^.!?]+[.!?]+|[^.!?]+$)"), F.lit(1))
    return _exploded(files, pack(F.transform(parts, lambda s: F.trim(s)), limit, " "))


def markdown_chunks(files: DataFrame, limit: int = SIZE) -> DataFrame:
    """Sections begin at headings and are packed; ``section_title`` is the chunk's first heading."""
    parts = F.split(F.regexp_replace("content", r"(?m)^(#{1,6} )", "\u0001$1"), "\u0001")
    return _exploded(files, pack(parts, limit, "\n")).withColumn("section_title", F.regexp_extract("content", r"(?m)^#{1,6} +([^\n]*)", 1))


def section_chunks(files: DataFrame, limit: int = SIZE) -> DataFrame:
    """The cascade: files by headings if there are any, else by paragraphs, else by fixed windows; oversize packs are cut."""
    by_heading = pack(F.split(F.regexp_replace("content", r"(?m)^(#{1,6} )", "\u0001$1"), "\u0001"), limit, "\n")
    by_paragraph = pack(F.split("content", r"\n\s*\n", -1), limit)
    packs = F.when(F.col("content").rlike(r"(?m)^#{1,6} "), by_heading).otherwise(by_paragraph)
    cut = F.flatten(F.transform(packs, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(limit)), lambda s: F.substring(p, s + 1, F.lit(limit)))))
    return _exploded(files, cut)


def merge_small(chunks: DataFrame, limit: int = SIZE) -> DataFrame:
    """Neighbouring chunks of a path packed together."""
    ordered = chunks.groupBy("file_seq", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"]).alias("parts"))
    return _exploded(ordered, pack(F.col("parts"), limit))


def function_chunks(files: DataFrame, limit: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(path, name, chunk_id, start_line, content): one chunk a function, cut into overlapping windows beyond ``limit``; text outside functions is left out."""
    from .structure import functions

    f = functions(files).join(files.select(F.col("file_seq").alias("_s"), "content"), F.col("file_seq") == F.col("_s"))
    body = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start_line"), F.col("length")), "\n")
    whole = f.select("file_seq", "path", "name", "start_line", body.alias("body"))
    cuts = F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), F.lit(limit - overlap))
    return whole.select("file_seq", "path", "name", "start_line", "body", F.posexplode(F.when(F.length("body") > limit, cuts).otherwise(F.array(F.lit(0)))).alias("chunk_id", "_at")).select("file_seq", "path", "name", "start_line", "chunk_id", F.substring(F.col("body"), F.col("_at") + 1, F.lit(limit)).alias("content"))


def word_packs(words: Column, limit: int, overlap_words: int = 0) -> Column:
    """array<string>: words joined by single spaces, as many as ``limit`` characters hold; a pack begins with the last ``overlap_words`` of the one before.  A longer word is a pack of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, word: Column) -> Column:
        joined = F.when(acc["open"] == "", word).otherwise(F.concat(acc["open"], F.lit(" "), word))
        fits = F.length(joined) <= limit
        tail = F.array_join(F.slice(F.split(acc["open"], " "), -F.least(F.lit(overlap_words), F.size(F.split(acc["open"], " "))), F.lit(overlap_words)), " ") if overlap_words else F.lit("")
        next_open = F.when(acc["open"] == "", F.lit("")).otherwise(F.concat_ws(" ", F.nullif(tail, F.lit("")), word))
        closed = F.when(acc["open"] == "", word).otherwise(acc["open"])
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(closed))).alias("done"), F.when(fits, joined).otherwise(next_open).alias("open"))

    return F.aggregate(F.filter(words, lambda w: w != ""), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def size_chunks(files: DataFrame, limit: int = SIZE, overlap_words: int = 0) -> DataFrame:
    """Words packed by size; white space becomes single spaces."""
    return _exploded(files, word_packs(F.split("content", r"\s+"), limit, overlap_words))


#: Where a piece of code may begin.
CODE_STARTS = r"(?m)^((?:export\s+)?(?:async\s+)?function\s+\w|(?:export\s+)?class\s+\w|(?:export\s+)?(?:const|let|var)\s+\w+\s*=|/\*\*)"


def code_chunks(files: DataFrame, limit: int = SIZE, overlap_words: int = 0) -> DataFrame:
    """Code cut before functions, classes, declarations and doc comments, and packed; a longer piece is packed by words.

    ``start`` and ``end`` are the chunk's place in the text (null for packed
    words, which are not in it as they are), ``section_title`` the name that
    its first line declares.
    """
    pieces = F.filter(F.split(F.regexp_replace("content", CODE_STARTS, "\u0001$1"), "\u0001"), lambda p: p != "")
    packed = F.flatten(F.transform(pack(pieces, limit, ""), lambda p: F.when(F.length(p) > limit, word_packs(F.split(p, r"\s+"), limit, overlap_words)).otherwise(F.array(F.regexp_replace(p, r"^\s+|\s+$", "")))))
    chunks = _exploded(files, F.filter(packed, lambda c: c != ""))
    return placed(chunks, files).withColumn("section_title", F.nullif(F.regexp_extract("content", r"^[^\n]*?(?:function|class|const|let|var)\s+(\w+)", 1), F.lit("")))


def placed(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with ``start`` and ``end``, counted from 0: the first place after the previous chunk's start at which each is in its text, or null."""
    by_file = chunks.groupBy("file_seq", "path").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "content", "token_count"))).alias("c"))
    j = by_file.join(files.select("file_seq", F.col("content").alias("_t")), "file_seq")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, c: Column) -> Column:
        hit = F.position(c["content"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t")))
        start = F.when(hit > 0, hit - 1 + acc["at"])
        return F.struct(F.coalesce(start + 1, acc["at"]).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate("c", first, step, lambda acc: acc["starts"])
    rows = j.select("file_seq", "path", F.posexplode(F.arrays_zip("c", starts.alias("s"))).alias("_k", "z"))
    return rows.select("file_seq", "path", F.col("z.c.chunk_id").alias("chunk_id"), F.col("z.c.content").alias("content"), F.col("z.c.token_count").alias("token_count"), F.col("z.s").alias("start"), (F.col("z.s") + F.length("z.c.content")).alias("end"))


def json_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk_id, key, content): the elements of a JSON array or the members of an object; other texts give nothing."""
    v = F.try_parse_json("content")
    keyed = files.where(v.isNotNull()).withColumn("_v", v)
    return keyed.select("file_seq", "path", F.expr("_v").alias("_v")).lateralJoin(keyed.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("file_seq", "path", F.col("pos").alias("chunk_id"), "key", F.to_json("value").alias("content"))


def summary_tree(chunks: DataFrame, levels: int = 3) -> DataFrame:
    """(path, level, node, first_chunk, last_chunk): groups of ceil(sqrt(n)) neighbours, level by level, until one node is left.

    The chunk ids of a path meet in one row, and all its nodes are made there:
    one aggregation, where levels that join each other would put many sorts
    into one task.
    """
    ids = chunks.where("path is not null").groupBy("path").agg(F.sort_array(F.collect_list(F.col("chunk_id").cast("long"))).alias("ids"))
    group = F.ceil(F.sqrt(F.size("ids"))).cast("double")
    width = [F.lit(1.0)] + [group * F.pow(F.greatest(group, F.lit(2.0)), F.lit(k - 1)) for k in range(1, levels + 1)]
    nodes = F.concat(*[_level(k, width[k], width[max(k - 1, 0)]) for k in range(levels + 1)])
    return ids.select("path", F.explode(nodes).alias("n")).select("path", "n.*")


def _level(k: int, width: Column, below: Column) -> Column:
    """The nodes of a level from the sorted ``ids``: one for each quotient by its width, if the level below has more than one; level 0 has every id."""
    node = lambda number, first, last: F.struct(F.lit(k).alias("level"), number.alias("node"), first.alias("first_chunk"), last.alias("last_chunk"))
    if k == 0:
        return F.transform("ids", lambda x: node(x, x, x))
    differ = lambda x, other, w: F.coalesce(F.floor(x / w) != F.floor(other / w), F.lit(True))  # noqa: E731  # there is no other beyond the ends
    first = F.filter("ids", lambda x, i: differ(x, F.get("ids", i - 1), width))
    last = F.filter("ids", lambda x, i: differ(x, F.get("ids", i + 1), width))
    more = F.size("ids") > 1 if k == 1 else differ(F.get("ids", F.lit(0)), F.get("ids", F.size("ids") - 1), below)
    return F.when(more, F.zip_with(first, last, lambda a, b: node(F.floor(a / width), a, b))).otherwise(F.array())


def overlap_relevance(query: str, text: str) -> float:
    """The offline stand-in for a model: the share of the query's words that the text has; short texts give 0.5."""
    words = {w for w in query.lower().split() if len(w) > 2}
    if len(text) < 400:
        return 0.5
    low = text.lower()
    return sum(w in low for w in words) / len(words) if words else 0.0


def map_chunks(chunks: DataFrame, query: str, relevance=overlap_relevance, answer=lambda query, text: text[:200], threshold: float = 0.3) -> DataFrame:
    """(path, chunk_id, relevance, response) of the chunks that reach the threshold; the two callables may call any model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = [relevance(query, t) for t in b.content]
            yield pd.DataFrame({"file_seq": b.file_seq, "path": b.path, "chunk_id": b.chunk_id, "relevance": score, "response": [answer(query, t) if s >= threshold else "" for s, t in zip(score, b.content)]})

    scored = chunks.select("file_seq", "path", F.col("chunk_id").cast("int").alias("chunk_id"), "content").mapInPandas(run, "file_seq long, path string, chunk_id int, relevance double, response string")
    return scored.where(F.col("relevance") >= threshold)


def merge_results(results: DataFrame, budget: int) -> DataFrame:
    """By relevance, up to the first response that would exceed the budget of characters."""
    from pyspark.sql import Window

    order = Window.partitionBy().orderBy(F.desc("relevance"), "file_seq", "chunk_id")
    run = results.withColumn("_sum", F.sum(F.length("response")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("_sum") <= budget).drop("_sum")

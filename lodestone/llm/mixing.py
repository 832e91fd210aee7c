"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of seed and id) and laid end
to end, row by row; block b of a source holds the documents that begin in its tokens
[b * block_tokens, (b + 1) * block_tokens).  Slot t of the schedule takes the
golden-ratio point x = t * 2654435769 mod 2**32 through the cumulative weights
to a source, and the r-th slot of a source takes the source's r-th block.
Any stretch of slots is then close to the weights.  All of it is integer
arithmetic, so every engine gives the same schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

ALPHA = 0.7
BLOCK_TOKENS = 16_384
MAX_EPOCHS = 1
SEED = 1
_GOLDEN = 2_654_435_769
_CELL = 1 << 20  # of the 2**32 points


def token_estimate(text):
    """A quarter of the characters, rounded up; 0 for a null or empty text."""
    return F.coalesce(F.floor((F.length(text) + 3) / 4), F.lit(0)).cast("long")


def running_start(df: DataFrame, group: str, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    Two levels: within a part of the group, and over the sums of earlier
    parts.  No task sees more than a part, however large the group is.
    """
    before = Window.unboundedPreceding
    sums = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    base = sums.select(group, part, F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy(part).rowsBetween(before, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(group, part).orderBy(*order).rowsBetween(before, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(base, [group, part]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def row_hash(docs: DataFrame):
    """A hash of all columns that can be hashed; rows equal in them are interchangeable."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _unhashable(f.dataType)])


def _unhashable(kind) -> bool:
    return any(x in kind.simpleString() for x in ("map<", "variant"))


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, row_hash, source, tokens, block) for every document with an id; a null source is the source ''."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), token_estimate(F.col(text_col)).alias("tokens"), key.alias("key"))
    rows = checkpoint(rows).withColumn("part", F.substring("key", 1, 3))
    placed = running_start(rows, "source", "part", ["key", "doc_id", "tokens", "row_hash"], "tokens", "start")
    return placed.select("doc_id", "row_hash", "source", "tokens", F.floor(F.col("start") / block_tokens).cast("long").alias("block"))


def source_weights(placed: DataFrame, alpha: float = ALPHA, max_epochs: int = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, tokens, blocks, lo, hi): each source's share of the 2**32 points.

    With ``targets`` the shares are those, to scale; sources that it does not
    name get none, and a name with a weight but without tokens is an error.
    Without, the weight is the share of tokens to the power ``alpha``, and no
    more than ``max_epochs`` of what the source has, so that a small source
    ends no schedule.  Blocks are counted by all tokens of the source.
    """
    blocks = F.floor((F.sum("tokens") + block_tokens - 1) / block_tokens)
    per = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), blocks.alias("blocks")).where("tokens > 0")
    every = Window.partitionBy()
    share = per.withColumn("share", F.col("tokens") / F.sum("tokens").over(every))
    if targets is None:
        target = share.withColumn("raw", F.pow("share", F.lit(float(alpha)))).withColumn("target", F.least(F.col("raw") / F.sum("raw").over(every), F.col("share") * max_epochs))
    else:
        wanted = {k: float(v) for k, v in targets.items() if v}
        if not wanted or min(wanted.values()) < 0:
            raise ValueError("targets need a weight above 0 and none below")
        share = checkpoint(share)
        missing = wanted.keys() - {r.source for r in share.where(F.col("source").isin(*wanted)).select("source").collect()}
        if missing:
            raise ValueError(f"targets out of reach, sources without tokens: {sorted(missing)}")
        given = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
        target = share.withColumn("target", F.coalesce(given[F.col("source")], F.lit(0.0)))
    points = target.withColumn("points", F.floor(F.round(F.col("target") / F.sum("target").over(every), 9) * 4294967296).cast("long")).where("points > 0")
    hi = F.sum("points").over(Window.partitionBy().orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    return points.select("source", "tokens", "blocks", (hi - F.col("points")).alias("lo"), hi.alias("hi"))


def schedule_length(weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> int:
    """Slots until the first source has given its blocks ``max_epochs`` times, so the weights hold to the end."""
    least = F.min(F.floor(F.col("blocks") * max_epochs * 4294967296 / (F.col("hi") - F.col("lo"))))
    return int(weights.agg(F.least(least, F.sum("blocks") * max_epochs)).first()[0] or 0)


def schedule(weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(slot, source, block, epoch) of as many slots as ``schedule_length`` says."""
    slots = schedule_length(weights, max_epochs)
    points = weights.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.pmod(F.col("id"), F.lit(1 << 31)) * _GOLDEN % (1 << 32)).alias("x"))
    cells = weights.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / _CELL), F.floor((F.col("hi") - 1) / _CELL))))
    hit = points.withColumn("cell", F.floor(F.col("x") / _CELL)).join(cells, "cell").where("x >= lo and x < hi").select("slot", "source", "blocks", F.lit(1).alias("one"), F.floor(F.col("slot") / 65536).alias("part"))
    ranked = running_start(hit, "source", "part", ["slot"], "one", "rank").where(F.col("rank") < F.col("blocks") * max_epochs)
    return ranked.select("slot", "source", F.pmod("rank", "blocks").alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def _scheduled(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = SEED, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS, targets: dict[str, float] | None = None) -> tuple[DataFrame, int]:
    """(the rows of laid_out() with slot and epoch, the number of slots)."""
    placed = checkpoint(laid_out(docs, id_col, text_col, source_col, seed, block_tokens))
    weights = checkpoint(source_weights(placed, alpha, max_epochs, block_tokens, targets))
    return placed.join(schedule(weights, max_epochs), ["source", "block"]), schedule_length(weights, max_epochs)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(slot, source, block, epoch, doc_id, tokens): the documents of every slot of the schedule.

    Options: seed, alpha, block_tokens, max_epochs, targets.  The sources'
    shares of the slots are the weights of source_weights() over the whole
    schedule; it ends when the first source would run out.

    A document longer than a block fills later blocks too; such a block may
    begin no document and gives no row.  Rows without an id can't be placed
    and are left out.  Null and empty texts count no token and come with the
    block they fall in; a source without tokens gets no slot.  Rows that
    repeat are placed each, one behind the other, over a block's edge too.
    Columns of any other name are not read but for telling rows apart.  An
    empty table gives no row.
    """
    return _scheduled(docs, id_col, text_col, source_col, **options)[0].select("slot", "source", "block", "epoch", "doc_id", "tokens")


def mixing_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, tokens, blocks, target, slots, share, exhausted): what each source is to give and gives.

    ``exhausted`` marks the sources that end the schedule.
    """
    placed = checkpoint(laid_out(docs, id_col, text_col, source_col, seed, block_tokens))
    weights = checkpoint(source_weights(placed, alpha, max_epochs, block_tokens, targets))
    total = schedule_length(weights, max_epochs)
    slots = schedule(weights, max_epochs).groupBy("source").agg(F.count("*").alias("slots"))
    joined = weights.join(slots, "source", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    points = F.col("hi") - F.col("lo")
    return joined.select("source", "tokens", "blocks", (points / F.lit(2.0**32)).alias("target"), "slots", (F.col("slots") / F.lit(max(total, 1))).alias("share"), ((F.lit(total + 1) * points / F.lit(2.0**32)) > F.col("blocks") * max_epochs).alias("exhausted"))


#: Estimated tokens of a partition of the mixed documents, in slots that follow each other.
RUN_TOKENS = 1 << 25


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, **options) -> DataFrame:
    """The scheduled documents in the schedule's order, with the columns that came.

    Partitions follow each other in the schedule and are sorted by slot, so
    files written from them hold it in the order of their numbers and rows.
    A row comes once for each slot it is placed in: a document scheduled in
    several epochs once an epoch, rows that repeat once each.  Rows without an
    id are left out.  Null and empty texts, very long ones, extra columns and
    an empty table: see mixed().

    Equal rows are interchangeable, so their slots are gathered and given out
    to one of them; the texts move twice, to their slots and into order.
    """
    key, same, slots, at, n, run = (fresh(x, docs) for x in ("slot_id", "slot_row", "slots", "slot", "nth", "run"))
    found, total = _scheduled(docs, id_col, text_col, source_col, block_tokens=block_tokens, **options)
    places = found.groupBy(F.col("doc_id").alias(key), F.col("row_hash").alias(same)).agg(F.collect_list("slot").alias(slots))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * block_tokens // RUN_TOKENS))
    parts = max(1, min(total, parts))
    one = docs.where(F.col(id_col).isNotNull()).withColumn(key, F.col(id_col).cast("long")).withColumn(same, row_hash(docs))
    one = one.withColumn(n, F.row_number().over(Window.partitionBy(key, same).orderBy(key))).where(F.col(n) == 1)
    laid = one.join(places, [key, same]).withColumn(at, F.explode(slots)).withColumn(run, F.floor(F.col(at) * parts / max(total, 1)).cast("int"))
    return laid.repartitionById(parts, F.col(run)).sortWithinPartitions(at, key).select(*docs.columns)


ORACLE = f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce((length(text) + 3) // 4, 0)::BIGINT AS tokens, md5(concat('{SEED}:', doc_id)) AS key
  FROM {{documents}} WHERE doc_id IS NOT NULL),
placed AS (
  SELECT doc_id, source, tokens, (coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {BLOCK_TOKENS})::BIGINT AS block FROM base),
per AS (SELECT source, sum(tokens)::BIGINT AS tokens, (sum(tokens)::BIGINT + {BLOCK_TOKENS} - 1) // {BLOCK_TOKENS} AS blocks FROM placed GROUP BY source HAVING sum(tokens) > 0),
share AS (SELECT *, tokens::DOUBLE / (sum(tokens) OVER ())::DOUBLE AS share FROM per),
target AS (SELECT source, blocks, least(pow(share, {ALPHA}) / sum(pow(share, {ALPHA})) OVER (), share * {MAX_EPOCHS}) AS target FROM share),
points AS (SELECT source, blocks, floor(round(target / sum(target) OVER (), 9) * 4294967296)::BIGINT AS points FROM target),
bounds AS (SELECT source, blocks, points, (sum(points) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING))::BIGINT AS hi FROM points WHERE points > 0),
slots AS (SELECT unnest(range(coalesce((SELECT least(min(floor(blocks * {MAX_EPOCHS} * 4294967296.0 / points)), sum(blocks) * {MAX_EPOCHS})::BIGINT FROM bounds), 0))) AS slot),
hit AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN bounds ON (slot * {_GOLDEN}) % 4294967296 >= hi - points AND (slot * {_GOLDEN}) % 4294967296 < hi),
plan AS (SELECT slot, source, rank % blocks AS block, rank // blocks AS epoch FROM hit WHERE rank < blocks * {MAX_EPOCHS})
SELECT slot, placed.source AS source, placed.block AS block, epoch, doc_id, tokens FROM placed JOIN plan ON placed.source = plan.source AND placed.block = plan.block
"""

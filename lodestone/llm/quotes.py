"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

A line's quote level is its number of leading '>' marks.  Lines of one level
that follow each other are a passage; it is normalised (marks off, joined over
line ends, lower case, white space collapsed), so a quotation that was wrapped
anew is the same passage.  Its windows of WINDOW words (of all its words if it
has fewer) are hashed and joined to those of the unquoted text of earlier
messages of the conversation, so a quotation of a part of a message links too.
The message that a reply quotes at the lowest level is its parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = r"^[ \t]*>[> \t]*"
#: A line like 'On Monday Ann wrote:' that introduces a quotation.
_ATTRIBUTION = r"(?:wrote|writes|schrieb|escribió|écrit)[ \t]*:[ \t\r]*$"
WINDOW = 8


def cut_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, k, level, body) of the lines of messages; a line that introduces a quotation has level -1."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    lines = lines.withColumn("mark", F.regexp_extract("line", _MARK, 0)).withColumn("raw", F.length(F.regexp_replace("mark", "[^>]", "")))
    after = F.coalesce(F.lead("raw").over(Window.partitionBy("conv_id", "turn").orderBy("k")), F.lit(0))
    introduces = F.col("line").rlike(_ATTRIBUTION) & (F.col("raw") == 0) & (after > 0)
    return lines.select("conv_id", "turn", "k", F.when(introduces, -1).otherwise(F.col("raw")).alias("level"), F.substring("line", F.length("mark") + 1, F.length("line")).alias("body"))


def _joined(by: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), by)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")


def _windows(words: str, size: str) -> Column:
    """The hash of every window of ``size`` words."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - F.col(size) + 1), lambda i: F.md5(F.array_join(F.slice(words, i, F.col(size)), " ").cast("binary")))
    return F.when(F.size(words) >= F.col(size), hashed)


def linked_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(conv_id, turn, role, parent_turn, quoted_passages, linked_passages, quoted_turns, text), one row a message.

    A passage links to the earlier message of its conversation that holds most
    of its windows, half of them at least (of equals the latest).
    ``parent_turn`` is the message that has most windows among the links of
    the lowest level with any (of equals the latest); a message without such a
    link answers the one before it.  ``text`` is what is left without
    quotations and the lines that introduce them.  ``quoted_turns`` are all
    messages it links to at any level, sorted.

    Rows without a conversation or turn are left out.  A null or empty text is
    empty; a very long one is matched whole, its windows are rows.  Of several
    rows with a conversation and turn, repeated ones too, the one with the
    least text, then role, stays.  Other columns, whatever their names, are
    not read.  An empty table gives no row.
    """
    key = Window.partitionBy("conv_id", "turn").orderBy("text", "role")
    m = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    m = m.where("conv_id is not null and turn is not null").repartition("conv_id").withColumn("_n", F.row_number().over(key)).where("_n = 1")
    order = Window.partitionBy("conv_id").orderBy("turn")
    quotes = F.col("text").rlike(r"(?:^|\n)[ \t]*>")
    m = m.select("conv_id", "turn", "role", "text", F.lag("turn").over(order).alias("before"), quotes.alias("quotes"))

    lines = cut_lines(m.where("quotes"))
    left = lines.where("level = 0").groupBy("conv_id", "turn").agg(_joined("\n").alias("left"))
    m = m.join(left, ["conv_id", "turn"], "left").withColumn("text", F.when(F.col("quotes"), F.coalesce("left", F.lit(""))).otherwise(F.col("text")))
    run = F.col("k") - F.row_number().over(Window.partitionBy("conv_id", "turn", "level").orderBy("k"))
    passage = lines.where("level > 0").withColumn("run", run).groupBy("conv_id", "turn", "level", "run").agg(_words(_joined(" ")).alias("words")).where(F.size("words") > 0)
    passage = passage.withColumn("size", F.least(F.size("words"), F.lit(window)))
    quoted = passage.select("conv_id", "turn", "level", "run", "size", (F.size("words") - F.col("size") + 1).alias("windows"), F.explode(_windows("words", "size")).alias("hash")).groupBy("conv_id", "turn", "level", "run", "size", "windows", "hash").agg(F.count("*").alias("n"))

    # only conversations that quote, and only windows of the sizes they need
    sizes = passage.groupBy("conv_id").agg(F.collect_set("size").alias("sizes"))
    original = m.join(sizes, "conv_id").select("conv_id", F.col("turn").alias("origin"), _words(F.col("text")).alias("words"), "sizes")
    original = original.select("conv_id", "origin", "words", F.explode("sizes").alias("size")).select("conv_id", "origin", "size", F.explode(_windows("words", "size")).alias("hash")).distinct()

    hit = quoted.join(original, ["conv_id", "size", "hash"]).where("origin < turn").groupBy("conv_id", "turn", "level", "run", "windows", "origin").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("conv_id", "turn", "level", "run").orderBy(F.desc("n"), F.desc("origin"))
    link = hit.where("2 * n >= windows").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    votes = link.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"), F.count("*").alias("passages"))
    best = Window.partitionBy("conv_id", "turn").orderBy("level", F.desc("n"), F.desc("origin"))
    parent = votes.withColumn("_rank", F.row_number().over(best)).groupBy("conv_id", "turn").agg(F.max(F.when(F.col("_rank") == 1, F.col("origin"))).alias("parent"), F.sum("passages").alias("linked_passages"), F.sort_array(F.collect_set("origin")).alias("quoted_turns"))
    found = passage.groupBy("conv_id", "turn").agg(F.count("*").alias("quoted_passages")).join(parent, ["conv_id", "turn"], "left")

    own = F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return m.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.coalesce("parent", "before").alias("parent_turn"), F.coalesce("quoted_passages", F.lit(0)).alias("quoted_passages"),
        F.coalesce("linked_passages", F.lit(0)).alias("linked_passages"), F.coalesce("quoted_turns", F.array().cast("array<long>")).alias("quoted_turns"), own.alias("text"),
    )


def reply_order(conv: np.ndarray, turn: np.ndarray, parent: np.ndarray, rooted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, depth) of each row of whole conversations sorted by conversation and turn.

    Each message is followed by its replies, in the order of their turns, each
    with its own replies.  A parent precedes its replies in turn, so one pass
    backward sums the sizes of the subtrees and one forward gives the places.
    """
    n = len(conv)
    at = {key: k for k, key in enumerate(zip(conv.tolist(), turn.tolist()))}
    up = [-1 if r else at[c, p] for c, p, r in zip(conv.tolist(), parent.tolist(), rooted.tolist())]
    size = [1] * n
    for k in range(n - 1, -1, -1):
        if up[k] >= 0:
            size[up[k]] += size[k]
    place, depth, free = [0] * n, [0] * n, [0] * n
    top = {}
    for k, c in enumerate(conv.tolist()):
        if up[k] < 0:
            place[k] = top.get(c, 0)
            top[c] = place[k] + size[k]
        else:
            place[k], depth[k] = free[up[k]], depth[up[k]] + 1
            free[up[k]] += size[k]
        free[k] = place[k] + 1
    return np.array(place, np.int64), np.array(depth, np.int64)


def conversations(linked: DataFrame) -> DataFrame:
    """(conv_id, n_messages, linked_passages, turns, parent_turns, depths, roles, texts), one row a conversation.

    The arrays run in reply order: each message is followed by its replies.
    The first message has parent_turn -1 and depth 0; a null role is ''.
    Batches hold whole conversations, so memory is that of the longest one.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_messages", pa.int64()), ("linked_passages", pa.int64()), *[(x, pa.list_(pa.int64())) for x in ("turns", "parent_turns", "depths")], ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def made(t: pa.Table) -> pa.RecordBatch:
        conv, turn = t["conv_id"].to_numpy(), t["turn"].to_numpy()
        rooted = t["parent_turn"].is_null().to_numpy(zero_copy_only=False)
        parent = t["parent_turn"].fill_null(-1).to_numpy()
        place, depth = reply_order(conv, turn, parent, rooted)
        order = np.lexsort((place, conv))
        edge = np.concatenate([np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])), [len(conv)]])
        offsets = pa.array(edge, pa.int32())
        many = [pa.array(turn[order]), pa.array(parent[order]), pa.array(depth[order]), t["role"].take(pa.array(order)).combine_chunks(), t["text"].take(pa.array(order)).combine_chunks()]
        return pa.RecordBatch.from_arrays([pa.array(conv[edge[:-1]]), pa.array(np.diff(edge)), pa.array(np.add.reduceat(t["linked_passages"].to_numpy(), edge[:-1])), *[pa.ListArray.from_arrays(offsets, x) for x in many]], schema=schema)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            cut = int(np.searchsorted(conv, conv[-1]))  # where the last conversation begins, which may go on
            if rest and cut == 0 and rest[-1].column(0)[-1].as_py() == conv[0]:
                rest.append(batch)
                continue
            head = [*rest, *([batch.slice(0, cut)] if cut else [])]
            if head:
                yield made(pa.Table.from_batches(head))
            rest = [batch.slice(cut)]
        if rest:
            yield made(pa.Table.from_batches(rest))

    rows = linked.select("conv_id", "turn", "parent_turn", "linked_passages", F.coalesce("role", F.lit("")).alias("role"), "text")
    kinds = "conv_id long, n_messages long, linked_passages long, turns array<long>, parent_turns array<long>, depths array<long>, roles array<string>, texts array<string>"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(built, kinds)


ORACLE = rf"""
WITH RECURSIVE m0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM {{conversations}} WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST, role NULLS FIRST) AS n FROM m0) WHERE n = 1),
cut AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM m),
marked AS (SELECT *, regexp_extract(line, '{_MARK}', 0) AS mark FROM cut),
leveled AS (SELECT *, length(regexp_replace(mark, '[^>]', '', 'g')) AS raw, substr(line, length(mark) + 1) AS body FROM marked),
line AS (SELECT conv_id, turn, k, body, CASE WHEN raw = 0 AND regexp_matches(line, '{_ATTRIBUTION}') AND coalesce(lead(raw) OVER (PARTITION BY conv_id, turn ORDER BY k), 0) > 0 THEN -1 ELSE raw END AS level FROM leveled),
island AS (SELECT *, k - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY k) AS run FROM line WHERE level > 0),
passage AS (SELECT *, least(len(words), {WINDOW}) AS size FROM (
  SELECT conv_id, turn, level, run, list_filter(string_split_regex(lower(string_agg(body, ' ' ORDER BY k)), '[ 	
]+'), lambda w: w <> '') AS words FROM island GROUP BY ALL) WHERE len(words) > 0),
quoted AS (SELECT conv_id, turn, level, run, size, windows, hash, count(*) AS n FROM (
  SELECT conv_id, turn, level, run, size, len(words) - size + 1 AS windows, unnest(list_transform(range(1, len(words) - size + 2), lambda i: md5(array_to_string(list_slice(words, i, i + size - 1), ' ')))) AS hash FROM passage) GROUP BY ALL),
own AS (SELECT conv_id, turn, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE level = 0), '') AS body FROM line GROUP BY ALL),
original AS (SELECT DISTINCT conv_id, origin, size, hash FROM (
  SELECT o.conv_id, o.turn AS origin, s.size, unnest(list_transform(range(1, len(o.words) - s.size + 2), lambda i: md5(array_to_string(list_slice(o.words, i, i + s.size - 1), ' ')))) AS hash
  FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(body), '[ 	
]+'), lambda w: w <> '') AS words FROM own) o JOIN (SELECT DISTINCT conv_id, size FROM passage) s ON o.conv_id = s.conv_id)),
hit AS (SELECT q.conv_id, q.turn, q.level, q.run, q.windows, o.origin, sum(q.n)::BIGINT AS n FROM quoted q JOIN original o ON q.conv_id = o.conv_id AND q.size = o.size AND q.hash = o.hash AND o.origin < q.turn GROUP BY ALL),
link AS (SELECT * FROM hit WHERE 2 * n >= windows QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level, run ORDER BY n DESC, origin DESC) = 1),
votes AS (SELECT conv_id, turn, level, origin, sum(n)::BIGINT AS n, count(*) AS passages FROM link GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) AS rank FROM votes),
parent AS (SELECT conv_id, turn, max(CASE WHEN rank = 1 THEN origin END) AS parent, sum(passages)::BIGINT AS linked_passages, list_sort(list(DISTINCT origin)) AS quoted_turns FROM ranked GROUP BY ALL),
linked AS (SELECT m.conv_id, m.turn, m.role, coalesce(p.parent, m.before) AS parent_turn, (SELECT count(*) FROM passage x WHERE x.conv_id = m.conv_id AND x.turn = m.turn) AS quoted_passages, coalesce(p.linked_passages, 0) AS linked_passages,
  coalesce(p.quoted_turns, []::BIGINT[]) AS quoted_turns, regexp_replace(o.body, '^[ 	
]+|[ 	
]+$', '', 'g') AS text
  FROM m JOIN own o ON m.conv_id = o.conv_id AND m.turn = o.turn LEFT JOIN parent p ON m.conv_id = p.conv_id AND m.turn = p.turn),
walk AS (SELECT conv_id, turn, [turn] AS path FROM linked WHERE parent_turn IS NULL
  UNION ALL SELECT l.conv_id, l.turn, list_append(w.path, l.turn) FROM walk w JOIN linked l ON l.conv_id = w.conv_id AND l.parent_turn = w.turn)
"""
#: The messages, and the conversations that the query returns.
ORACLE_MESSAGES = ORACLE + "SELECT conv_id, turn, role, parent_turn, quoted_passages, linked_passages, quoted_turns, text FROM linked"
ORACLE += """SELECT l.conv_id, count(*) AS n_messages, sum(linked_passages)::BIGINT AS linked_passages, list(l.turn ORDER BY path) AS turns, list(coalesce(parent_turn, -1) ORDER BY path) AS parent_turns,
  list(len(path) - 1 ORDER BY path) AS depths, list(coalesce(role, '') ORDER BY path) AS roles, list(text ORDER BY path) AS texts FROM linked l JOIN walk w ON l.conv_id = w.conv_id AND l.turn = w.turn GROUP BY l.conv_id"""

#: Conversations whose messages quote others of the same conversation: two of three quote the message two before, cut
#: and wrapped to six or four words, one of them with the message three before nested in it, wrapped to five.
_FLAT = r"trim(regexp_replace(coalesce({}, ''), '[ \t\r\n]+', ' '{}))"
QUOTING = """
WITH base AS (SELECT conv_id, turn, role, text, split({two}, ' ') AS w2, split({three}, ' ') AS w3, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
  FROM {conversations} WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn, role, CASE
  WHEN k % 3 = 2 THEN concat('On Monday someone wrote:', chr(10), {by6}, chr(10), coalesce(text, ''))
  WHEN k % 3 = 0 AND k > 3 THEN concat('A wrote:', chr(10), {by5}, chr(10), {by4}, chr(10), coalesce(text, ''))
  ELSE text END AS text FROM base
"""


def quoting_sql(conversations: str, dialect: str) -> str:
    """The query QUOTING for 'spark' or 'duckdb'."""
    duck = dialect == "duckdb"
    over = "OVER (PARTITION BY conv_id ORDER BY turn)"
    flat = lambda x: _FLAT.format(x, ", 'g'" if duck else "")

    def wrapped(words: str, mark: str, lo: int, many: int, width: int) -> str:
        if duck:
            cut = f"list_slice({words}, {lo}, {lo + many - 1})"
            return f"array_to_string(list_transform(range(0, greatest(len({cut}), 1), {width}), lambda i: concat('{mark}', array_to_string(list_slice({cut}, i + 1, i + {width}), ' '))), chr(10))"
        cut = f"slice({words}, {lo}, {many})"
        return f"array_join(transform(sequence(0, greatest(size({cut}), 1) - 1, {width}), i -> concat('{mark}', array_join(slice({cut}, i + 1, {width}), ' '))), chr(10))"

    two, three = (flat(f"lag(text, {k}) {over}") for k in (2, 3))
    return QUOTING.format(conversations=conversations, two=two, three=three, by6=wrapped("w2", "> ", 3, 60, 6), by5=wrapped("w3", "> > ", 1, 25, 5), by4=wrapped("w2", "> ", 2, 400, 4))

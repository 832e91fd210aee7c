"""Questions and answers: cleaning and splitting questions, judging findings and answers, annotated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.corpus import lines
from .structure import dead_regions
from .verify import resolve_paths

# questions


def sanitized(query: Column) -> Column:
    """A question as plain text: braces doubled, emphasis, headings, backticks and fences off, two line ends at most."""
    out = F.replace(F.replace(query, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    for pattern, by in ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"(?m)^#+\s*", ""), (r"`([^`]+)`", "$1"), (r"```[^\n]*\n?", ""), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


#: Words that name no thing to search for.
PLAIN_WORDS = ("a", "after", "all", "an", "any", "are", "before", "check", "checking", "condition", "conditions", "could", "find", "for", "in", "is", "look", "missing", "not", "properly", "race", "search", "should", "that", "the", "validation", "when", "where", "which", "with", "without")
_SUFFIX_HINTS = ((".swift", ("swift", "ios", "xcode")), (".ts", ("typescript", "ts")), (".js", ("javascript", "js", "react", "phaser")), (".py", ("python", "py")))


def search_pattern(description: Column) -> Column:
    """A regex for what a description speaks of: up to five identifiers, else its quoted texts, else its first long words, else anything."""
    named = F.filter(F.regexp_extract_all(description, F.lit(r"\b([a-z_][a-z0-9_]*(?:[A-Z][a-zA-Z0-9_]*)?)\b"), F.lit(1)), lambda w: ~F.lower(w).isin(*PLAIN_WORDS) & (F.length(w) > 2))
    quoted = F.regexp_extract_all(description, F.lit('"([^"]+)"'), F.lit(1))
    long = F.slice(F.filter(F.split(description, r"\s+"), lambda w: F.length(w) > 4), 1, 3)
    plain = lambda ws: F.array_join(F.transform(ws, lambda w: F.regexp_replace(w, r"([^A-Za-z0-9_])", r"\\$1")), "|")
    return F.when(F.size(named) > 0, F.array_join(F.slice(named, 1, 5), "|")).when(F.size(quoted) > 0, plain(quoted)).when(F.size(long) > 0, plain(long)).otherwise(".*")


def file_filter(description: Column) -> Column:
    """The suffix that a description hints at, or null."""
    low, out = F.lower(description), F.lit(None).cast("string")
    for suffix, hints in reversed(_SUFFIX_HINTS):
        hit = F.lit(False)
        for h in hints:
            hit = hit | low.contains(h)
        out = F.when(hit, suffix).otherwise(out)
    return out


def numbered_items(questions: DataFrame, query_col: str = "query") -> DataFrame:
    """All columns and (number, description, pattern, file_filter): the items '(1) ... (2) ...' of a question.

    A question without any gives its parts between commas, 'and' and 'or' that
    have more than ten characters.  An item that holds another parenthesis is
    none.
    """
    q = F.col(query_col)
    heads = F.slice(F.split(F.regexp_replace(q, r"\(\s*(\d+)\s*\)\s*", "\u0001$1\u0002"), "\u0001"), 2, 10_000)
    items = F.transform(heads, lambda h: F.named_struct(F.lit("number"), F.substring_index(h, "\u0002", 1).try_cast("int"), F.lit("body"), F.regexp_replace(F.substring_index(h, "\u0002", -1), r"^\s+|\s+$", "")))
    items = F.filter(items, lambda s: (s["body"] != "") & ~s["body"].contains("("))
    items = F.transform(items, lambda s: F.named_struct(F.lit("number"), s["number"], F.lit("description"), F.regexp_replace(s["body"], r"\.+$", "")))
    parts = F.transform(F.split(q, r"\s*(?:,|\band\b|\bor\b)\s*"), lambda p, k: F.named_struct(F.lit("number"), k + 1, F.lit("description"), F.regexp_replace(p, r"^\s+|\s+$", "")))
    parts = F.filter(parts, lambda s: F.length(s["description"]) > 10)
    found = questions.withColumn("_items", items).withColumn("_parts", parts)
    found = found.select(*questions.columns, F.explode(F.when(F.size("_items") > 0, F.col("_items")).otherwise(F.col("_parts"))).alias("_i")).select(*questions.columns, "_i.number", "_i.description")
    return found.withColumn("pattern", search_pattern(F.col("description"))).withColumn("file_filter", file_filter(F.col("description")))


#: kind of question -> what to ask instead, one thing at a time.
SUBQUESTIONS = {
    "security": ("Where does input reach a query, a shell or an evaluator?", "Which keys, passwords or tokens stand in the source?", "Which endpoints lack a check of who is asking?", "Where do sensitive values get logged or stored in the clear?"),
    "quality": ("Which functions are too long or branch too often?", "Where are errors swallowed or never handled?", "What is duplicated, unreachable or unexplained?", "Where are types missing or forced?"),
    "architecture": ("Which modules are there and where does the program start?", "How do data enter, change and leave?", "Which modules depend on each other in circles or know too much?"),
    "ios": ("Where are values unwrapped by force or held in cycles?", "What touches the interface off the main thread?", "Which views own state that they should observe?"),
    "performance": ("Which loops query, allocate or copy more than they need?", "What is kept in memory without a bound?"),
}
DETAILS = {
    "security": "injection; secrets in source; missing checks of identity; exposure of data", "quality": "length and branching; handling of errors; duplication and dead code", "architecture": "modules; flow of data; coupling",
    "ios": "memory; concurrency; view state", "performance": "work in loops; memory; caching",
}
_REPORT = "Give file and line, the code, a confidence and a fix for each finding."


def subquestions(spark, questions: DataFrame, kind_col: str = "type") -> DataFrame:
    """All columns and (part, subquestion); a kind without its own asks the first two of security and of quality."""
    rows = [(k, n, q) for k, qs in SUBQUESTIONS.items() for n, q in enumerate(qs, 1)]
    rows += [("*", n, q) for n, q in enumerate(SUBQUESTIONS["security"][:2] + SUBQUESTIONS["quality"][:2], 1)]
    table = spark.createDataFrame(rows, "_kind string, part int, subquestion string")
    kind = F.when(F.col(kind_col).isin(*SUBQUESTIONS), F.col(kind_col)).otherwise("*")
    return questions.withColumn("_k", kind).join(table, F.col("_k") == F.col("_kind")).select(*questions.columns, "part", "subquestion")


def enhanced(query: Column, kind: Column) -> Column:
    """The question with what to look at for its kind, and how to report."""
    about = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])[kind]
    return F.concat(query, F.coalesce(F.concat(F.lit("\n\nLook at: "), about, F.lit(".")), F.lit("")), F.lit("\n" + _REPORT))


# findings and answers


def _locate(part: Column, text: Column, start: Column) -> Column:
    """The place of a part from a place on, counted from 1, or 0."""
    at = F.instr(F.substring(text, start, F.length(text)), part) if isinstance(part, str) else F.position(part, F.substring(text, start, F.length(text)))
    return F.when(at > 0, at + start - 1).otherwise(0)


def context_check(code: Column, context: Column) -> Column:
    """struct<valid, reason>: a finding whose first 20 characters follow a comment mark, or stand between docstring or
    block comment marks, anywhere in its context, is none; test words in the context are a note."""
    low, part = F.lower(context), F.lower(F.substring(code, 1, 20))

    def after(mark: str) -> Column:
        first = F.instr(low, mark)
        return F.when(first > 0, _locate(part, low, first + len(mark))).otherwise(0)

    def between(opens: str, closes: str) -> Column:
        hit = after(opens)
        return (hit > 0) & (F.when(hit > 0, _locate(closes, low, hit + F.length(part))).otherwise(0) > 0)

    test = F.lit(False)
    for word in ("test_", "_test.", "spec.", "mock", "fixture", "assert"):
        test = test | low.contains(word)
    said = lambda valid, reason: F.struct(F.lit(valid).alias("valid"), F.lit(reason).alias("reason"))
    return (
        F.when(after("#") > 0, said(False, "in a comment")).when(between('"""', '"""') | between("'''", "'''"), said(False, "in a docstring")).when(after("//") > 0, said(False, "in a comment"))
        .when(between("/*", "*/"), said(False, "in a block comment")).when(test, said(True, "near tests")).otherwise(said(True, "verified"))
    )


#: intent -> (words of a question, words of an answer that addresses it); the first that a question has counts.
INTENTS = {
    "security": (("auth", "credential", "injection", "password", "secret", "security", "token", "vulnerability", "xss"), ("vulnerab", "secret", "injection", "auth")),
    "ios": (("cloudkit", "ios", "retain cycle", "swift", "uikit", "weak self"), ("unwrap", "retain", "thread", "swiftui")),
    "quality": (("code smell", "complexity", "dead code", "fixme", "quality", "refactor", "todo"), ("long function", "smell", "todo", "complexity")),
    "architecture": (("architecture", "dependency", "design", "import", "layer", "module", "structure"), ("module", "dependenc", "layer")),
    "performance": (("bottleneck", "latency", "leak", "memory", "optimize", "performance", "slow"), ("memory", "slow", "inefficien")),
    "crash": (("crash", "exception", "fatal", "nil"), ("unwrap", "nil", "fatal")),
    "persistence": (("cache", "database", "load", "persist", "save", "storage"), ("storage", "persist", "data flow")),
    "state": (("binding", "mutation", "observable", "redux", "state", "viewmodel"), ("mutation", "binding", "observable")),
}


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def intent(query: Column) -> Column:
    low, out = F.lower(query), F.lit("general")
    for name, (asked, _) in reversed(INTENTS.items()):
        out = F.when(_any(low, asked), name).otherwise(out)
    return out


def judged_answers(answers: DataFrame, files: DataFrame, id_col: str = "id", query_col: str = "query", answer_col: str = "answer") -> DataFrame:
    """(id, intent, aligned, n_references, checks, score, status): whether answers address their question and are specific.

    Alignment: 0.7 for no finding, 0.3 for two vague phrases, 0.4 if none of
    the intent's words occurs, else 0.6 and 0.4 of their share; it counts half
    if the intent is not addressed.  Checks: references, line numbers, code,
    confidence, files that exist, lines that exist.  The score is 0.4 of the
    alignment and 0.6 of the checks' share.  PASSED needs 0.7, references and
    code; WARNING 0.5 and an addressed intent; an empty answer is FAILED.
    """
    text, low = F.coalesce(F.col(answer_col), F.lit("")), F.lower(F.coalesce(F.col(answer_col), F.lit("")))
    a = answers.select(F.col(id_col).alias("id"), intent(F.col(query_col)).alias("intent"), text.alias("answer"), low.alias("low"))
    share = F.lit(0.0)
    for name, (_, wanted) in {**INTENTS, "general": ((), ("finding",))}.items():
        hits = sum((F.col("low").contains(w).cast("int") for w in wanted), F.lit(0))
        share = F.when(F.col("intent") == name, hits / len(wanted)).otherwise(share)
    vague = sum((F.col("low").contains(w).cast("int") for w in ("consider checking", "could potentially", "generally speaking", "in theory", "may have", "might be", "possibly")), F.lit(0))
    none = _any(F.col("low"), ("0 findings", "no findings", "no issues", "no relevant", "no vulnerabilities", "nothing found"))
    a = a.withColumn("share", share).withColumn("alignment", F.when(none, 0.7).when(vague >= 2, 0.3).when(F.col("share") == 0, 0.4).otherwise(0.6 + 0.4 * F.col("share"))).withColumn("aligned", F.col("alignment") >= 0.6)

    path = r"([A-Za-z0-9_/.-]+\.[A-Za-z]{1,5}):(\d+)"
    pairs = F.array_distinct(F.zip_with(F.regexp_extract_all("answer", F.lit(path), F.lit(1)), F.regexp_extract_all("answer", F.lit(path), F.lit(2)), lambda f, n: F.struct(f.alias("file"), n.try_cast("int").alias("line"))))
    refs = resolve_paths(a.select("id", F.explode(pairs).alias("r")).select("id", "r.file", "r.line"), files)
    sizes = files.select(F.col("path").alias("_p"), F.size(F.split("content", "\n", -1)).alias("n_lines"))
    known = refs.join(sizes, F.col("resolved") == F.col("_p"), "left")
    counts = known.groupBy("id").agg(F.count("*").alias("n_references"), F.bool_or(F.col("line") > 0).alias("lines"), F.bool_and(F.col("resolved").isNotNull()).alias("files_exist"), F.bool_and(F.coalesce(F.col("line") <= F.col("n_lines"), F.lit(True))).alias("lines_exist"))
    j = a.join(counts, "id", "left").withColumn("n_references", F.coalesce("n_references", F.lit(0)))
    code = F.col("answer").rlike(r"(?s)```[a-z]*\n.*?\n```") | F.exists(F.regexp_extract_all("answer", F.lit("`([^`]{10,})`"), F.lit(1)), lambda s: s.rlike("[({=.]"))
    sure = F.col("answer").rlike(r"(?i)\b(?:HIGH|MEDIUM|LOW)\b.*confidence|\[[^\n]*?(?:HIGH|MEDIUM|LOW)[^\n]*?\]")
    passed = {"references": F.col("n_references") > 0, "lines": F.coalesce("lines", F.lit(False)), "code": code, "confidence": sure, "files_exist": F.coalesce("files_exist", F.lit(True)), "lines_exist": F.coalesce("lines_exist", F.lit(True))}
    checks = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in passed.items()]))
    j = j.withColumn("checks", checks)
    score = F.round(0.4 * F.col("alignment") * F.when(F.col("aligned"), 1.0).otherwise(0.5) + 0.6 * F.size("checks") / len(passed), 6)
    critical = F.array_contains("checks", "references") & F.array_contains("checks", "code")
    empty = F.col("answer").rlike(r"^\s*$")
    j = j.withColumn("score", F.when(empty, 0.0).otherwise(score)).withColumn("aligned", F.col("aligned") & ~empty)
    status = F.when(empty, "FAILED").when((F.col("score") >= 0.7) & critical, "PASSED").when((F.col("score") >= 0.5) & F.col("aligned"), "WARNING").otherwise("FAILED")
    return j.select("id", "intent", "aligned", "n_references", "checks", "score", status.alias("status"))


# annotated texts


def numbered_text(files: DataFrame, wanted: str, most: int = 500) -> DataFrame:
    """(path, text): the first file whose path contains or ends with the wanted one, each line with its number."""
    chosen = files.where(F.col("path").contains(wanted)).orderBy("file_seq").limit(1)
    cut = F.split("content", "\n", -1)
    shown = F.array_join(F.transform(F.slice(cut, 1, most), lambda x, k: F.concat((k + 1).cast("string"), F.lit(": "), x)), "\n")
    more = F.when(F.size(cut) > most, F.concat(F.lit("\n... ("), (F.size(cut) - most).cast("string"), F.lit(" more lines)"))).otherwise("")
    return chosen.select("path", F.concat(shown, more).alias("text"))


def marked_dead_code(files: DataFrame) -> DataFrame:
    """(file_seq, path, content): lines that mark where dead regions begin and end; only files that may have any are cut into lines."""
    some = files.where(F.col("content").contains("#if"))
    regions = dead_regions(some)
    starts = regions.select("file_seq", "path", F.col("start_line").alias("line_no"), F.lit(True).alias("starts")).distinct()
    ends = regions.select("file_seq", "path", F.col("end_line").alias("line_no"), F.lit(True).alias("ends")).distinct()
    key = ["file_seq", "path", "line_no"]
    ls = lines(some).join(starts, key, "left").join(ends, key, "left")
    head = F.when(F.col("starts"), F.concat(F.lit("[DEAD CODE START: "), F.regexp_replace("line", r"^\s+|\s+$", ""), F.lit("]\n"))).otherwise("")
    marked = ls.withColumn("line", F.concat(head, "line", F.when(F.col("ends"), F.lit("\n[DEAD CODE END]")).otherwise("")))
    joined = marked.groupBy("file_seq", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    rest = files.where(~F.coalesce(F.col("content").contains("#if"), F.lit(False))).select("file_seq", "path", "content")
    return rest.unionByName(joined)


# tokens and cost

#: Dollars per million tokens: input, cached read, cached write.
PRICES = (3.0, 0.3, 3.75)
#: The fewest tokens worth a cache entry, by size of model.
LEAST_CACHED = {"large": 4096, "medium": 1024, "small": 2048}


def token_stats(text: Column, tokens: Column | None = None) -> Column:
    """struct<total_tokens, characters, tokens_per_char, input_cost, cached_read_cost, cached_write_cost>."""
    n = T.estimate_tokens(text) if tokens is None else tokens
    per = F.when(F.length(text) > 0, F.round(n / F.length(text), 6)).otherwise(0.0)
    costs = [F.round(n / 1_000_000 * p, 9).alias(name) for p, name in zip(PRICES, ("input_cost", "cached_read_cost", "cached_write_cost"))]
    return F.struct(n.alias("total_tokens"), F.length(text).alias("characters"), per.alias("tokens_per_char"), *costs)


def worth_caching(tokens: Column, size: str = "medium") -> Column:
    return tokens >= LEAST_CACHED[size]


def cache_plan(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", size: str = "medium") -> DataFrame:
    """(conv_id, turn, tokens, prefix_tokens, breakpoint): where a conversation's prefix is to be cached.

    Messages have four tokens of frame each and a conversation three.  The
    last message is a breakpoint if the prefix up to it is worth caching.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col)
    tokens = T.estimate_tokens(F.coalesce(F.col(text_col), F.lit(""))) + 4
    m = messages.select(F.col(conv_col), F.col(turn_col), tokens.cast("long").alias("tokens"))
    m = m.withColumn("prefix_tokens", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 3)
    last = F.lead(turn_col).over(order).isNull()
    return m.withColumn("breakpoint", last & worth_caching(F.col("prefix_tokens"), size))


def cache_usage(requests: DataFrame, read: str = "read_tokens", write: str = "write_tokens") -> DataFrame:
    """One row: requests, hits, misses, writes, hit_rate, tokens_saved and cost_saved; a read costs a tenth of an input."""
    r, w = F.coalesce(F.col(read), F.lit(0)), F.coalesce(F.col(write), F.lit(0))
    saved = F.coalesce(F.sum(r), F.lit(0))
    counts = requests.agg(F.count("*").alias("requests"), F.count_if(r > 0).alias("hits"), F.count_if((r == 0) & (w == 0)).alias("misses"), F.count_if(w > 0).alias("writes"), saved.cast("long").alias("tokens_saved"))
    rate = F.when(F.col("requests") > 0, F.round(F.col("hits") / F.col("requests"), 6)).otherwise(0.0)
    return counts.withColumn("hit_rate", rate).withColumn("cost_saved", F.round(F.col("tokens_saved") / 1_000_000 * (PRICES[0] - PRICES[1]), 6))


def context_stats(chunks: DataFrame, tree: DataFrame, doc_col: str = "path") -> DataFrame:
    """One row: documents, total_tokens, chunks and the depths of the documents' trees, sorted; only a count for each depth meets in one task."""
    by_doc = chunks.groupBy(doc_col).agg(F.sum("token_count").alias("t"), F.count("*").alias("c"))
    sums = by_doc.agg(F.count(doc_col).alias("documents"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))
    counts = tree.groupBy(doc_col).agg(F.max("level").alias("depth")).groupBy("depth").agg(F.count("*").cast("int").alias("n"))
    repeated = F.transform(F.sort_array(F.collect_list(F.struct("depth", "n"))), lambda x: F.array_repeat(x["depth"], x["n"]))
    return sums.crossJoin(counts.agg(F.flatten(repeated).alias("depths")))

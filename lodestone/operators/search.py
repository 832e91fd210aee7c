"""Search over lines: regex, literal, several at once, with context, and by keyword frequency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.corpus import lines

PLAIN = re.compile(r"[\w\s/:;,@#%&=<>'\"~`-]+")


def matcher(pattern: str, ignore_case: bool = True, fixed: bool = False, word: bool = False) -> "callable":
    """A predicate on a line.  A pattern without metacharacters becomes a substring test."""
    if word:
        pattern, fixed = r"\b(?:" + (re.escape(pattern) if fixed else pattern) + r")\b", False
    if fixed or PLAIN.fullmatch(pattern):
        return (lambda line: F.lower(line).contains(pattern.lower())) if ignore_case else (lambda line: line.contains(pattern))
    return lambda line: line.rlike(("(?iu)" if ignore_case else "") + pattern)


def search(files: DataFrame, pattern: str, suffix: str | None = None, exclude: str | None = None, ignore_case: bool = True, fixed: bool = False, word: bool = False, per_file: int | None = None) -> DataFrame:
    """(file_seq, path, line_no, line, match): lines that match, stripped, with the first matching text.

    ``exclude`` is case-sensitive and drops lines first.  ``per_file`` keeps
    the first lines of each file.
    """
    source = files.where(F.col("path").endswith(suffix)) if suffix else files
    ls = lines(source)
    if exclude:
        ls = ls.where(~F.col("line").rlike(exclude))
    hit = ls.where(matcher(pattern, ignore_case, fixed, word)(F.col("line")))
    text = re.escape(pattern) if fixed else pattern
    out = hit.select("file_seq", "path", "line_no", P.stripped(F.col("line")).alias("line"), F.regexp_extract("line", ("(?iu)" if ignore_case else "") + text, 0).alias("match"))
    if per_file:
        w = Window.partitionBy("file_seq", "path").orderBy("line_no")
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_file).drop("_n")
    return out


def grep(files: DataFrame, pattern: str, mode: str = "content", cap: int = 1000, **options) -> DataFrame:
    """mode: content (first ``cap`` lines in file order), files_with_matches, or count (by file)."""
    found = search(files, pattern, **options)
    if mode == "content":
        return found.orderBy("file_seq", "path", "line_no").limit(cap)
    if mode == "files_with_matches":
        return found.select("path").distinct()
    return found.groupBy("path").agg(F.count("*").alias("n_matches"))


def custom_search(files: DataFrame, pattern: str, description: str = "Custom match", suffix: str | None = None, max_results: int = 100, exclude_tests: bool = False, exclude_comments: bool = True, category: str = "custom", severity: str = "MEDIUM", confidence: str = "HIGH") -> DataFrame:
    """Scored findings of one pattern, the first ``max_results`` in file order.

    The given confidence acts as a floor when it is HIGH and as a ceiling when
    it is LOW; MEDIUM leaves the score's verdict.
    """
    hit = search(files, pattern, suffix)
    path, line = F.col("path"), F.col("line")
    if exclude_comments:
        hit = hit.where(~P.is_comment(line))
    if exclude_tests:
        hit = hit.where(~P.is_test_path(path))
    scored = P.line_confidence(line, path)
    final = F.lit("HIGH") if confidence == "HIGH" else F.lit("LOW") if confidence == "LOW" else scored
    return (
        hit.orderBy("file_seq", "path", "line_no").limit(max_results)
        .select("file_seq", path.alias("file"), F.col("line_no").alias("line"), F.substring(line, 1, 200).alias("code"), F.lit(description).alias("issue"), final.alias("confidence"), F.lit(severity).alias("severity"), F.lit(category).alias("category"))
    )


def multi_search(files: DataFrame, searches: list[tuple[str, str]], cap: int = 50, combine: bool = True) -> DataFrame:
    """(search_no, description, file_seq, file, line, code): up to ``cap`` lines a search.

    All patterns are tested in one pass over the lines.  With ``combine`` a
    file's line is given once, for the first search that has it.
    """
    tests = [F.when(matcher(p)(F.col("line")), F.struct(F.lit(k + 1).alias("search_no"), F.lit(d).alias("description"))) for k, (p, d) in enumerate(searches)]
    hits = lines(files).select("file_seq", "path", "line_no", "line", F.explode(F.array_compact(F.array(*tests))).alias("s"))
    flat = hits.select("s.search_no", "s.description", "file_seq", F.col("path").alias("file"), F.col("line_no").alias("line"), P.stripped(F.col("line")).alias("code"))
    order = Window.partitionBy("search_no").orderBy("file_seq", "file", "line")
    flat = flat.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    if combine:
        first = Window.partitionBy("file_seq", "file", "line").orderBy("search_no")
        flat = flat.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return flat


#: Bytes of terms that one automaton holds; more terms take several passes over the files.
TERM_BYTES = 16 << 20


def literal_search(files: DataFrame, terms: DataFrame, term_col: str = "term", pass_bytes: int = TERM_BYTES) -> DataFrame:
    """(term, file_seq, path, line_no, line): case-insensitive substrings, every term against every line.

    The terms are measured and sent to the files in parts of ``pass_bytes`` at
    most, each as one automaton, whose time doesn't depend on their number.
    """
    t = terms.select(F.col(term_col).alias("term"), F.lower(term_col).alias("_low")).where("_low <> ''").distinct()
    size = t.agg(F.coalesce(F.sum(F.octet_length("_low")), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    out = None
    for n in range(passes):
        made = _literal_pass(files, t if passes == 1 else t.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == n))
        out = made if out is None else out.unionByName(made)
    return out


def _literal_pass(files: DataFrame, t: DataFrame) -> DataFrame:
    sent = files.sparkSession.sparkContext.broadcast([(r.term, r["_low"]) for r in t.collect()])

    def run(batches):
        import ahocorasick
        import pandas as pd

        names: dict[str, list[str]] = {}
        for term, low in sent.value:
            names.setdefault(low, []).append(term)
        automaton = ahocorasick.Automaton()
        for low, which in names.items():
            automaton.add_word(low, which)
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for seq, path, content in zip(batch.file_seq, batch.path, batch.content):
                for k, line in enumerate(content.split("\n") if names and content is not None else (), 1):
                    hit = {term for _, which in automaton.iter(line.lower()) for term in which}
                    rows += [(term, seq, path, k, line) for term in sorted(hit)]
            yield pd.DataFrame(rows, columns=["term", "file_seq", "path", "line_no", "line"])

    return files.select("file_seq", "path", "content").mapInPandas(run, "term string, file_seq long, path string, line_no int, line string")


def with_context(files: DataFrame, pattern: str, before: int = 3, after: int = 3, ignore_case: bool = True) -> DataFrame:
    """(path, line_no, line, context_before, context_after): neighbours as arrays, by slices of the file's lines.

    Nothing is shuffled: a file's lines are one array, and only matching
    positions are exploded.
    """
    test = matcher(pattern, ignore_case)
    arr = F.split("content", "\n", -1)
    hit = F.filter(F.transform(arr, lambda x, k: F.struct(k.alias("k"), test(x).alias("hit"))), lambda s: s["hit"])
    rows = files.withColumn("_lines", arr).select("file_seq", "path", "_lines", F.explode(F.transform(hit, lambda s: s["k"])).alias("k"))
    start = F.greatest(F.col("k") - before, F.lit(0))
    return rows.select("file_seq", "path", (F.col("k") + 1).alias("line_no"), F.get("_lines", F.col("k")).alias("line"), F.slice("_lines", start + 1, F.col("k") - start).alias("context_before"), F.slice("_lines", F.col("k") + 2, F.lit(after)).alias("context_after"))


def smart_filter(files: DataFrame, keywords: list[str], reach: int = 10, head: int = 50) -> DataFrame:
    """(path, line_no, line, gap): lines within ``reach`` of a keyword; ``gap`` marks a jump.

    A file without any keyword gives its first ``head`` lines.
    """
    near = Window.partitionBy("file_seq", "path").orderBy("line_no").rowsBetween(-reach, reach)
    whole = Window.partitionBy("file_seq", "path")
    order = Window.partitionBy("file_seq", "path").orderBy("line_no")
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.lower("line").contains(k.lower())
    marked = lines(files).withColumn("_hit", hit).withColumn("_near", F.max("_hit").over(near)).withColumn("_any", F.max("_hit").over(whole))
    kept = marked.where(F.col("_near") | (~F.col("_any") & (F.col("line_no") <= head)))
    return kept.withColumn("gap", F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(False))).select("file_seq", "path", "line_no", "line", "gap")


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """The number of non-overlapping occurrences of all keywords, in lower case."""
    low = F.lower(text)
    score = F.lit(0)
    for k in keywords:
        score = score + F.floor((F.length(low) - F.length(F.replace(low, F.lit(k.lower())))) / len(k)).cast("int")
    return score


def semantic_search(files: DataFrame, keywords: list[str], top: int = 10, cut: int = 8000) -> DataFrame:
    """The files with the most keyword occurrences, ties in file order."""
    scored = files.withColumn("score", keyword_score(F.col("content"), keywords)).where("score > 0")
    return scored.orderBy(F.desc("score"), "file_seq").limit(top).select("file_seq", "path", "score", F.substring("content", 1, cut).alias("excerpt"))


def read_lines(files: DataFrame, path: str, offset: int = 0, limit: int = 2000) -> DataFrame:
    return lines(files.where(F.col("path") == path)).where((F.col("line_no") > offset) & (F.col("line_no") <= offset + limit)).select("line_no", "line")


def find_file(files: DataFrame, wanted: str) -> DataFrame:
    """The exact path, else the first path that contains the wanted one."""
    match = F.when(F.col("path") == wanted, 0).when(F.col("path").contains(wanted), 1)
    return files.withColumn("_rank", match).where("_rank is not null").orderBy("_rank", "file_seq").limit(1).drop("_rank")


def suggestions(files: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """Paths that contain the wanted name, or whose last part is in it."""
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower("path").contains(wanted.lower()) | F.lit(wanted.lower()).contains(F.lower(name))).select("file_seq", "path").orderBy("file_seq").limit(most)


def list_files(files: DataFrame, part: str = "") -> DataFrame:
    """(extension, n_files, total_bytes) of the paths that contain ``part``, in any case."""
    return files.where(F.lower("path").contains(part.lower())).groupBy("extension").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))


def file_info(files: DataFrame) -> DataFrame:
    return files.select("file_seq", "path", "extension", F.length("content").cast("long").alias("n_chars"), F.size(F.split("content", "\n", -1)).alias("n_lines"), F.element_at(F.split("content", "\n", -1), 1).alias("first_line"))


def glob_files(files: DataFrame, pattern: str, most: int = 1000) -> DataFrame:
    """(path, total): paths that match a glob, hidden ones left out; ``total`` counts all of them."""
    parts = {"**/": r"(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    regex = "".join(parts.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", pattern))
    hit = files.where(F.col("path").rlike(f"^{regex}$") & ~F.col("path").rlike(r"(?:^|/)\.")).select("file_seq", "path")
    return hit.orderBy("file_seq").limit(most).crossJoin(hit.agg(F.count("*").alias("total")))

"""Checking findings and answers against the corpus."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.corpus import lines

_REFERENCE = r"([\w./-]+\.[A-Za-z]\w*):(\d+)"


def clean_path(path: Column) -> Column:
    """Without quotes, backticks, emphasis and a leading './'."""
    return F.regexp_replace(F.regexp_replace(path, r"^[\s`'\"*]+|[\s`'\"*:]+$", ""), r"^\./", "")


def references(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and (file, line): each distinct file:line that a text names."""
    files, nums = F.regexp_extract_all(text_col, F.lit(_REFERENCE), F.lit(1)), F.regexp_extract_all(text_col, F.lit(_REFERENCE), F.lit(2))
    pairs = F.array_distinct(F.zip_with(files, nums, lambda a, b: F.struct(clean_path(a).alias("file"), b.try_cast("int").alias("line"))))
    return texts.select("*", F.explode(pairs).alias("_r")).select(*texts.columns, "_r.file", "_r.line")


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1))


def resolve_paths(refs: DataFrame, files: DataFrame, file_col: str = "file") -> DataFrame:
    """refs with ``resolved``: the exact path, else one that ends with the other, else one with the same file name, else one whose path contains it.

    Candidates meet on the file name, so the join has keys; only references
    without any such candidate are compared with all paths.
    """
    want = refs.select(F.col(file_col).alias("_ref")).distinct().withColumn("_base", F.lower(F.substring_index("_ref", "/", -1)))
    have = files.select("file_seq", "path").withColumn("_base", F.lower(F.substring_index("path", "/", -1)))
    near = want.join(have, "_base").withColumn("_rank", F.when(F.col("path") == F.col("_ref"), 0).when(F.col("path").endswith(F.col("_ref")) | F.col("_ref").endswith(F.col("path")), 1).otherwise(2))
    left = want.join(near.select("_ref").distinct(), "_ref", "left_anti")
    loose = left.join(have.select("file_seq", "path"), F.col("path").contains(F.col("_ref"))).withColumn("_rank", F.lit(3))
    order = Window.partitionBy("_ref").orderBy("_rank", "file_seq")
    best = near.select("_ref", "path", "file_seq", "_rank").unionByName(loose.select("_ref", "path", "file_seq", "_rank")).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return refs.join(best.select(F.col("_ref").alias("_k"), F.col("path").alias("resolved"), F.col("_rank").alias("match_rank")), F.col(file_col) == F.col("_k"), "left").drop("_k")


def _line_matches(text: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """Whether a line has a match, in any case; a pattern that is none gives its error instead.  Each is compiled once a batch."""
    compiled: dict[str, re.Pattern | str] = {}
    for p in pattern.dropna().unique():
        try:
            compiled[p] = re.compile(p, re.IGNORECASE)
        except re.error as error:
            compiled[p] = f"invalid pattern: {error}"
    rows = []
    for t, p in zip(text, pattern):
        c = compiled.get(p)
        rows.append((False, c) if isinstance(c, str) else (bool(c and t is not None and c.search(t)), None))
    return pd.DataFrame(rows, columns=["matches", "error"])


def verify_lines(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (file, line, and perhaps pattern) with resolved, n_lines, text, in_range and matches, and pattern_error where there is a pattern.

    Only files that are referred to are cut into lines, and only the lines
    asked for are taken out.
    """
    found = resolve_paths(refs, files)
    named = files.select("path", "content").join(found.select(F.col("resolved").alias("path")).distinct(), "path", "left_semi")
    cut = named.select(F.col("path").alias("_p"), F.split("content", "\n", -1).alias("_lines"))
    out = found.join(cut, F.col("resolved") == F.col("_p"), "left").withColumn("n_lines", F.size("_lines")).withColumn("text", F.get("_lines", F.col("line") - 1))
    out = out.withColumn("n_lines", F.when(F.col("_p").isNotNull(), F.col("n_lines"))).drop("_p", "_lines")
    out = out.withColumn("in_range", F.coalesce(F.col("line").between(1, F.col("n_lines")), F.lit(False)))
    if "pattern" not in refs.columns:
        return out.withColumn("matches", F.col("text").isNotNull())
    return out.withColumn("_m", F.pandas_udf(_line_matches, "struct<matches boolean, error string>")("text", "pattern")).withColumn("matches", F.col("_m.matches")).withColumn("pattern_error", F.col("_m.error")).drop("_m")


def clamp_lines(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings beyond their file's end move to its last line and become LOW; unknown files stay as they are.

    A file is found as resolve_paths() does: exactly, else by the end of its
    path, its name, or a part of its path.
    """
    found = resolve_paths(findings, files)
    named = files.join(found.select(F.col("resolved").alias("path")).distinct(), "path", "left_semi")
    sized = named.select(F.col("path").alias("_p"), F.size(F.split("content", "\n", -1)).alias("_n"))
    j = found.join(sized, F.col("resolved") == F.col("_p"), "left")
    over = F.coalesce((F.col("_n") > 0) & (F.col("line") > F.col("_n")), F.lit(False))
    out = j.withColumn("confidence", F.when(over, "LOW").otherwise(F.col("confidence"))).withColumn("code", F.when(over, F.concat("code", F.lit(" [line adjusted]"))).otherwise(F.col("code")))
    return out.withColumn("line", F.when(over, F.col("_n")).otherwise(F.col("line"))).select(*findings.columns)


def verification_score(file_accuracy: Column, line_accuracy: Column, corrections: Column, warnings: Column) -> Column:
    """0.4 each for files and lines, and a tenth each that corrections and warnings use up; from 0 to 1."""
    score = 0.4 * file_accuracy + 0.4 * line_accuracy + (0.1 - F.least(0.02 * corrections, F.lit(0.1))) + (0.1 - F.least(0.01 * warnings, F.lit(0.1)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def verification_level(score: Column) -> Column:
    return F.when(score >= 0.9, "HIGH").when(score >= 0.7, "MEDIUM").when(score >= 0.5, "LOW").otherwise("VERY LOW")


def verification_stats(verified: DataFrame) -> DataFrame:
    """One row: distinct files found and named, lines in range, score and level; nothing to check counts as right."""
    agg = verified.agg(F.count_distinct("file").alias("files"), F.count_distinct(F.when(F.col("resolved").isNotNull(), F.col("file"))).alias("files_found"), F.count("*").alias("refs"), F.count_if("in_range").alias("lines_ok"), F.count_if(F.col("match_rank") > 0).alias("corrections"))
    fa = F.when(F.col("files") > 0, F.col("files_found") / F.col("files")).otherwise(1.0)
    la = F.when(F.col("refs") > 0, F.col("lines_ok") / F.col("refs")).otherwise(1.0)
    score = F.round(verification_score(fa, la, F.col("corrections"), F.col("refs") - F.col("lines_ok")), 6)
    return agg.withColumn("score", score).withColumn("level", verification_level(F.col("score")))


_ALIGNED_VAGUE = r"(?i)\b(?:it seems|might be|possibly|probably|could be|may be|unclear)\b"


def alignment(answer: Column, intent_words: list[str]) -> Column:
    """struct<score, aligned>: no finding 0.7; two vague phrases or more 0.3; none of the words 0.4; else 0.6 and 0.4 of their share."""
    vague = F.regexp_count(answer, F.lit(_ALIGNED_VAGUE))
    hits = F.lit(0)
    for w in intent_words:
        hits = hits + F.lower(answer).contains(w.lower()).cast("int")
    share = hits / max(1, len(intent_words))
    none = answer.rlike(r"(?i)\bno (?:issues?|findings?|matches|problems?)\b")
    return F.when(none, F.struct(F.lit(0.7).alias("score"), F.lit(True).alias("aligned"))).when(vague >= 2, F.struct(F.lit(0.3), F.lit(False))).when(hits == 0, F.struct(F.lit(0.4), F.lit(False))).otherwise(F.struct((0.6 + 0.4 * share), F.lit(True)))


def implementation_status(files: DataFrame, name: str) -> DataFrame:
    """(path, start_line, n_code_lines, is_stub): functions of that name and whether their body does anything."""
    from .structure import functions

    f = functions(files).where(F.col("name") == name)
    body = lines(files).select(F.col("file_seq").alias("_s"), F.col("line_no"), "line")
    j = f.join(body, (F.col("file_seq") == F.col("_s")) & (F.col("line_no") > F.col("start_line")) & (F.col("line_no") <= F.col("end_line")), "left")
    code = F.col("line").rlike(r"\S") & ~P.is_comment(F.col("line")) & ~F.col("line").rlike(r"^\s*[{}\])]+;?\s*$")
    stub = F.col("line").rlike(r"(?i)^\s*(?:pass|\.\.\.|return|return (?:nil|none|null)|raise NotImplementedError.*|fatalError\(.*\)|todo!\(.*\)|unimplemented!\(.*\))\s*;?\s*$")
    return j.groupBy("path", "start_line").agg(F.count_if(code).alias("n_code_lines"), (F.count_if(code & ~stub) == 0).alias("is_stub"))

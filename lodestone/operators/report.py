"""Roll-ups of findings and metrics, and rendering."""

from __future__ import annotations

import functools
import time
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P


def dedupe(findings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One finding a (file, line), the first by tool order."""
    w = Window.partitionBy("file", "line").orderBy(*(order or ["tool", "rule_seq"]))
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "confidence").agg(F.count("*").alias("n"))


def scanner_totals(findings: DataFrame) -> DataFrame:
    """One row: all findings and those of each severity and of high confidence, each counted once."""
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")], F.count_if(F.col("confidence") == "HIGH").alias("high_confidence"), F.count_distinct("file").alias("n_files"))


def severity_cube(findings: DataFrame) -> DataFrame:
    return findings.cube("severity", "confidence", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("grouping_id"))


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(P.rank(F.col("severity"), P.SEVERITY_RANK)), "file_seq", "line", "tool", "rule_seq")


def metrics(calls: DataFrame, name: str, value: str, success: str | None = None) -> DataFrame:
    """Per name: count, success rate, average, least, greatest, and p50, p95, p99 as the element int(n * q) of the sorted values.

    p95 is the greatest below 20 values and p99 below 100.  Only values and
    ranks are kept, so a hot name is one sorted partition and never an array.
    """
    w = Window.partitionBy(name)
    r = calls.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))

    def at(q: float, floor: int):
        k = F.when(F.col("_n") < floor, F.col("_n") - 1).otherwise(F.floor(F.col("_n") * q).cast("int"))
        return F.max(F.when(F.col("_r") == k, F.col(value)))

    rate = F.avg(F.col(success).cast("double")) if success else F.lit(1.0)
    return r.groupBy(name).agg(F.count("*").alias("n"), F.round(rate, 6).alias("success_rate"), F.round(F.avg(value), 6).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), at(0.5, 0).alias("p50"), at(0.95, 20).alias("p95"), at(0.99, 100).alias("p99"))


class CallLog:
    """Times calls of decorated functions on the driver; table() gives them to metrics()."""

    def __init__(self, keep: int = 1000):
        self.rows: deque[tuple] = deque(maxlen=keep)

    def timed(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **options):
            began, ok = time.perf_counter(), False
            try:
                out = f(*args, **options)
                ok = True
                return out
            finally:
                self.rows.append((f.__name__, (time.perf_counter() - began) * 1000, ok, datetime.now(timezone.utc)))

        return call

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "function_name string, elapsed_ms double, success boolean, ts timestamp")


def recent_metrics(calls: DataFrame, name: str, ts: str = "ts", keep: int = 1000, tie: str = "event_id") -> DataFrame:
    """The last ``keep`` rows of each name."""
    w = Window.partitionBy(name).orderBy(F.desc(ts), F.desc(tie))
    return calls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def markdown(findings: DataFrame, per_confidence: int = 20) -> str:
    """A report of the first findings of each confidence; only ranked rows reach the driver."""
    w = Window.partitionBy("confidence").orderBy(F.desc(P.rank(F.col("severity"), P.SEVERITY_RANK)), "file_seq", "line", "tool", "rule_seq")
    top = findings.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy("confidence"))).where(F.col("_n") <= per_confidence)
    rows = sorted(top.collect(), key=lambda r: (-P.CONFIDENCE_RANK[r.confidence], r["_n"]))
    out = ["# Findings"]
    for conf in dict.fromkeys(r.confidence for r in rows):
        own = [r for r in rows if r.confidence == conf]
        out.append(f"\n## {conf} confidence ({own[0]['_all']})")
        out += [f"- **{r.severity}** {r.file}:{r.line} {r.issue}\n  `{r.code}`" for r in own]
        if own[0]["_all"] > len(own):
            out.append(f"- ... and {own[0]['_all'] - len(own)} more")
    return "\n".join(out)


def table_markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows as a Markdown table, with a line for those left out; bars and line ends in cells are escaped."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(out + (["", f"... more than {most} rows"] if len(rows) > most else []))


def totals_markdown(findings: DataFrame) -> str:
    """How many findings there are, by severity and by confidence."""
    t = scanner_totals(findings).first()
    lines = [f"**{t.total} findings** in {t.n_files} files, {t.high_confidence} of high confidence", ""]
    return "\n".join(lines + [f"- {s}: {t[s.lower()]}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO") if t[s.lower()]])


def verification_markdown(verified: DataFrame, most: int = 20) -> str:
    """Score and level of checked references, and the first that are wrong."""
    from .verify import verification_stats

    s = verification_stats(verified).first()
    out = [f"**Verification: {s.level}** ({s.score:.2f})", "", f"- files found: {s.files_found} of {s.files}", f"- lines in range: {s.lines_ok} of {s.refs}", f"- paths corrected: {s.corrections}"]
    wrong = verified.where("not in_range").select("file", "line", "resolved", "n_lines").orderBy("file", "line")
    return "\n".join(out) + ("\n\n" + table_markdown(wrong, most) if s.lines_ok < s.refs else "")


def answers_markdown(judged: DataFrame) -> str:
    """Each judged answer with its status and what it lacks."""
    every = ("references", "lines", "code", "confidence", "files_exist", "lines_exist")
    out = []
    for r in judged.orderBy("id").collect():
        lacks = [c for c in every if c not in r.checks]
        out.append(f"- answer {r.id}: **{r.status}** ({r.score:.2f}), {r.intent}" + ("" if r.aligned else ", off the question") + (f"; lacks {', '.join(lacks)}" if lacks else ""))
    return "\n".join(out)


def results_markdown(results: DataFrame) -> str:
    """Responses of chunks in order of relevance, each under its path."""
    rows = results.orderBy(F.desc("relevance"), "file_seq", "chunk_id").collect()
    return "\n\n".join(f"### {r.path} (part {r.chunk_id}, relevance {r.relevance:.2f})\n{r.response}" for r in rows)

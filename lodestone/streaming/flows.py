"""Structured Streaming: the same expressions over files and events as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scanners
from ..sources.corpus import documents_as_files


def read_stream(spark: SparkSession, path: str, like: DataFrame, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(format).schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def scan_stream(documents: DataFrame, tools: list[str]) -> DataFrame:
    """Findings of a stream of documents; only per-row tools, so there is no state."""
    return scanners.rule_hits(scanners.lines(documents_as_files(documents)), [r for t in tools for r in scanners.TOOLS[t]])


def _timed(events: DataFrame, late: str) -> tuple[DataFrame, str]:
    """Events with a watermark, and the type that ts came in; watermarks need timestamps with a zone (the session's)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), dict(events.dtypes)["ts"]


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total) by event time; later rows than the watermark are dropped."""
    timed, kind = _timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = timed.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast(kind).alias("start"), F.col("window.end").cast(kind).alias("end"), "event_type", "n", "total")


def error_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): bursts of error events of a user."""
    timed, kind = _timed(events.where(F.col("event_type") == "error"), late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "n")


def latest_progress(events: DataFrame) -> DataFrame:
    """The last event of each user, as progress that overwrites itself."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


def upsert_table(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Merge each batch into a Parquet table of versions: batch n reads version n - 1 and writes version n, so a repeated batch gives the same.

    Versions before n - 1 are deleted once version n is written.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old = spark.createDataFrame([], batch.schema)
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker_stream(events: DataFrame, failures: int = 5, cool_seconds: int = 60) -> DataFrame:
    """(user_id, run, refused, open): the circuit breaker of each user after every batch, kept in state.

    As state.breaker(): open after ``failures`` failures in a row, it refuses
    calls until ``cool_seconds`` after the last failure; a success closes it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches, state: GroupState):
        run, last, refused = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, at in zip(rows.event_type, rows.ts.astype("datetime64[s]").astype("int64")):
            if run >= failures and at - last < cool_seconds:
                refused += 1
            elif kind == "error":
                run, last = run + 1, int(at)
            else:
                run = 0
        state.update((run, last, refused))
        yield pd.DataFrame({"user_id": [key[0]], "run": [run], "refused": [refused], "open": [run >= failures]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, run int, refused int, open boolean", "run int, last long, refused int", "update", GroupStateTimeout.NoTimeout)

"""The shared folder, and stores beside Parquet: tables of an SQLite file, and JSON corpora."""

from __future__ import annotations

import re
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import as_files


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Without that setting a session on one machine gets a temporary folder of
    that machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder.

    The files go when nothing refers to them, if the session has
    spark.cleaner.referenceTracking.cleanCheckpoints, as lodestone.session sets it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file in a folder that all executors share, in ``parts`` ranges of its row ids.

    ``schema`` names the columns to read; a missing table is an error, an
    empty one gives no row.
    """
    names = [c.split()[0] for c in schema.split(",")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        low, high = c.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {_quoted(table)}").fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    wanted = f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch.id.tolist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    rows = c.execute(wanted, (at, at + step))
                    while some := rows.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=names)

    return spark.range(low, high + 1, step, numPartitions=parts).mapInPandas(run, schema)


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """Append the rows to a table of an SQLite file and give their number; the driver is the only writer and holds one partition at a time."""
    names = df.columns
    many = 0
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({', '.join(map(_quoted, names))})")
        put = f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, names))}) VALUES ({', '.join('?' * len(names))})"
        for row in df.toLocalIterator():
            c.execute(put, [None if v is None else v if isinstance(v, (int, float, str, bytes)) else str(v) for v in row])
            many += 1
    return many


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """A corpus from JSON lines with path and content, in the order of the paths; lines that are no such object are left out."""
    rows = spark.read.schema("path string, content string").option("mode", "DROPMALFORMED").json(path).where("path is not null and content is not null")
    return as_files(rows, F.col("path"), F.col("content"), F.xxhash64("path"))

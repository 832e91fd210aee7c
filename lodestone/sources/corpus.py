"""Corpora as DataFrames: files (one row a file) and lines (one row a line).

A file has file_seq, path, extension, content, size_bytes and token_count (a
quarter of its characters).  file_seq gives the order that first-match and
first-fit operators use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_FILE_BYTES = 1_000_000
MAX_TOTAL_TOKENS = 500_000
EXTENSIONS = tuple(
    ".py .js .jsx .ts .tsx .mjs .cjs .vue .svelte .swift .rs .go .java .kt .rb .php .c .h .cc .cpp .hpp .cs .m .mm .scala .sql .sh .html .css .scss .sass .less "
    ".json .yaml .yml .toml .xml .ini .cfg .md .rst .txt".split()
)
SKIPPED_DIRECTORIES = tuple(".git .svn .hg node_modules __pycache__ .venv venv build dist target .idea .vscode .mypy_cache .pytest_cache Pods DerivedData".split())


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, dealt out to the cores; any other as it is.

    A file with one row group is one task, whatever its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def extension_of(path: Column) -> Column:
    """The lower-case suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def as_files(df: DataFrame, path: Column, content: Column, seq: Column) -> DataFrame:
    """Any table as files."""
    return df.select(seq.cast("long").alias("file_seq"), path.alias("path"), content.alias("content")).select(
        "file_seq", "path", extension_of(F.col("path")).alias("extension"), "content", F.octet_length("content").cast("long").alias("size_bytes"), estimate_tokens(F.col("content")).alias("token_count")
    )


def documents_as_files(documents: DataFrame) -> DataFrame:
    """path is source/doc_id.lang."""
    return as_files(documents, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")), F.col("text"), F.col("doc_id"))


def files_from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A small corpus from (path, content) pairs, in their order."""
    df = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(rows)], "seq long, path string, content string")
    return as_files(df, F.col("path"), F.col("content"), F.col("seq"))


def read_directory(spark: SparkSession, root: str, glob: str = "*", extensions: tuple[str, ...] = EXTENSIONS, skipped: tuple[str, ...] = SKIPPED_DIRECTORIES, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, skipped files with a reason) below a directory, recursively.

    Spark's file sources leave out empty files, so those are in neither.

    Suffixes and directory names are predicates on the path, sizes on the
    file's length, so contents of what is skipped are not read for it.
    Contents are UTF-8; other bytes are read as Latin-1.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace("path", r"^file:/+", "/")
    prefix = root.rstrip("/") + "/"
    relative = F.when(base.startswith(prefix), F.substring(base, len(prefix) + 1, 1 << 20)).otherwise(base)
    raw = raw.withColumn("path", relative)
    within = ~F.arrays_overlap(F.split(F.col("path"), "/"), F.array(*[F.lit(x) for x in skipped]))
    listed = raw.where(within & extension_of(F.col("path")).isin(*extensions))
    rejected = listed.where(F.col("length") > max_bytes).select("path", F.lit("too large").alias("reason"))
    text = F.when(F.is_valid_utf8(F.col("content")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    kept = listed.where(F.col("length") <= max_bytes).select("path", text.alias("content"))
    return as_files(kept, F.col("path"), F.col("content"), F.xxhash64("path")), rejected


def parse_corpus(df: DataFrame, text: Column) -> DataFrame:
    """Files from texts that hold several, each under a line '### File: path' and in a code fence.

    Of equal paths the last one counts.  The fence lines are dropped.
    """
    part = df.select(F.posexplode(F.split(F.concat(F.lit("\n"), text), "\n### File: ")).alias("seq", "part")).where("seq > 0")
    path = F.regexp_extract("part", r"^([^\n]+)", 1)
    body = F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n(?:```[^\n]*\n)?", ""), r"\s*\n```\s*$", "")
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    one = part.select("seq", path.alias("path"), body.alias("content")).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return as_files(one, F.col("path"), F.col("content"), F.col("seq"))


def lines(files: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(file_seq, path, extension, line_no, line, and columns of the file to carry): lines are counted from 1; '' has one empty line."""
    return files.select("file_seq", "path", "extension", *carried, F.posexplode(F.split("content", "\n", -1)).alias("k", "line")).select("file_seq", "path", "extension", (F.col("k") + 1).alias("line_no"), "line", *carried)


def within_budget(files: DataFrame, max_tokens: int = MAX_TOTAL_TOKENS) -> DataFrame:
    """First fit in file order: a file is skipped if it would exceed the budget, later smaller ones may still fit.

    Files of no token always fit.  The others are read in order, sequence
    numbers and counts only, until less is left than the smallest of them has;
    what is kept is bounded by the budget, whatever the corpus holds.
    """
    sized = files.where((F.col("token_count") <= max_tokens) & (F.col("token_count") > 0)).select("file_seq", "token_count")
    least = sized.agg(F.min("token_count")).first()[0]
    left, kept = max_tokens, []
    if least is not None:
        for r in sized.orderBy("file_seq").toLocalIterator():
            if r.token_count <= left:
                left -= r.token_count
                kept.append((r.file_seq,))
                if left < least:
                    break
    fits = files.sparkSession.createDataFrame(kept, "_seq long")
    chosen = files.where(F.col("token_count") > 0).join(fits, F.col("file_seq") == F.col("_seq"), "left_semi")
    return files.where(F.coalesce(F.col("token_count"), F.lit(0)) <= 0).unionByName(chosen) if max_tokens >= 0 else files.where("false")


def write_files(files: DataFrame, path: str, format: str = "parquet") -> None:
    """Sink of a corpus or of findings: parquet, orc, json or csv."""
    files.write.mode("overwrite").format(format).save(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))

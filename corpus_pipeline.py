"""From raw documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame that is written as Parquet and reread as the
next one's docs.  All but the last return the columns of documents, and other
columns that docs has.

What every stage does with odd rows: ids are whole numbers; a row without an
id passes the first three and is left out by mixing, which can't place it.
Null and empty texts are rejected by the rules; given to a later stage they
pass (and have no token).  Very long texts are worked on whole.  Rows that
repeat an id go or stay together, and each is placed and packed.  Ties: the
least id of a group of near copies stays.  Extra columns, whatever their
names, are carried along.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, mixing, quality_rules, simhash, token_pack
from lodestone.llm.common import delete, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose tokeniser fertility lies outside their language's bands."""
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, exactly or with a few words edited."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the source schedule takes, in its order."""
    return mixing.keep_mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, bit-packed in blocks; position is the schedule's order."""
    return token_pack.packed_tokens(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_pack", token_stage),
]

#: Tokenisers, SimHash and the CGK search are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed tokens of documents after all stages.

    A stage's table is deleted when the next one is written; the last one
    stays for the rows returned, which read it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

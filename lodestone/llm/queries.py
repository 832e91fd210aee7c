"""The ten operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, pii, quality_model, quality_rules, quotes, secrets, simhash, substring_dedup, token_pack
from .common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; its texts in one language are a repository."""
    repository = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    return secrets.owned_secrets(table(spark, sf_dir, "documents"), repository=repository)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.linked_messages(table(spark, sf_dir, "conversations")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.packed_tokens(table(spark, sf_dir, "documents"))


def quotes_of_quoting_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over conversations in which messages quote others, nested, in part and wrapped anew."""
    talk = table(spark, sf_dir, "conversations")
    return quotes.linked_messages(spark.sql(quotes.quoting_sql("{talk}", "spark"), talk=talk))


def quoting_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of the same messages, without quotes and in reply order."""
    return quotes.conversations(quotes_of_quoting_messages(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def more_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten operators over tables derived from the given ones, or with other parameters."""
    return {f.__name__: f for f in (quotes_of_quoting_messages, quoting_conversations)}


def oracle_sql() -> dict[str, str]:
    quoting = f"({quotes.quoting_sql('conversations', 'duckdb')})"
    return {
        "op3_secret_ownership": secrets.ORACLE, "op5_quote_linking": quotes.ORACLE.format(conversations="conversations"), "op8_source_mixing": mixing.ORACLE.format(documents="documents"),
        "quotes_of_quoting_messages": quotes.ORACLE_MESSAGES.format(conversations=quoting), "quoting_conversations": quotes.ORACLE.format(conversations=quoting),
    }

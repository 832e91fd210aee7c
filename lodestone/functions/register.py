"""The engine's functions under SQL names: scalar functions and table functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> list[str]:
    """Add lode_in_string(line, position), lode_chunks(text, size, overlap) and lode_corpus(text) to a session.

    What built-in functions can say stays SQL: lode_tokens and lode_comment
    are temporary SQL functions that Catalyst inlines.
    """
    from ..operators.scanners import in_string

    @F.pandas_udf("boolean")
    def lode_in_string(line: pd.Series, position: pd.Series) -> pd.Series:
        return pd.Series([in_string(a, int(b)) if a is not None else None for a, b in zip(line, position)])

    @F.udtf(returnType="chunk_id int, start int, content string")
    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            for k, at in enumerate(range(0, len(text or ""), size - overlap)):
                yield k, at, text[at : at + size]

    @F.udtf(returnType="path string, content string")
    class Corpus:
        def eval(self, text: str):
            import re

            found = {}
            for part in ("\n" + (text or "")).split("\n### File: ")[1:]:
                path, _, body = part.partition("\n")
                body = re.sub(r"^```[^\n]*\n", "", body)
                found[path] = re.sub(r"\s*\n```\s*$", "", body)
            yield from found.items()

    spark.udf.register("lode_in_string", lode_in_string)
    spark.udtf.register("lode_chunks", Chunks)
    spark.udtf.register("lode_corpus", Corpus)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lode_tokens(t STRING) RETURNS BIGINT RETURN floor(length(t) / 4)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION lode_comment(l STRING) RETURNS BOOLEAN RETURN l RLIKE '^\\s*(?:#|//|/\\*|\\*)'")
    return ["lode_in_string", "lode_chunks", "lode_corpus", "lode_tokens", "lode_comment"]

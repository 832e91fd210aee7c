"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of an edge; root is the least node of its component.

    Nodes that are their own root have no row.  Null ends and loops count for
    nothing.  Every round is two shuffles of the edges and is written to the
    shared folder, so neither lineage nor loss of an executor hurts.  Rounds
    grow as the logarithm of the edges; components not finished after
    ``most_rounds`` are an error.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e = checkpoint(e)
    before = _signature(e)
    for _ in range(most_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        near = large.select("u", "v", low.alias("m"))
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = checkpoint(small.where("u <> v").distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components are not finished after {most_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first())

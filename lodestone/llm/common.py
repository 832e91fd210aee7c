"""What the operators of this subpackage share: input tables, the shared folder, Arrow batches.

Ids are whole numbers of at most 64 bits: operators cast them to long, and a
text that is none is an error.  Ids of another kind need a number first, for
instance F.xxhash64.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import spread
from ..sources.store import checkpoint, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of fewer splits than cores is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, reread, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in the one column of ids, with all columns of docs as they are.

    An anti join: the ids are broadcast if Spark measures them below its
    threshold, else both sides are partitioned by id.
    """
    name = fresh("gone", docs)
    gone = ids.toDF(name).where(F.col(name).isNotNull()).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def slices(batch: pa.RecordBatch, text: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have about ``limit`` bytes, one row at least."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    total = np.cumsum(sizes)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        hi = min(hi, lo + 60_000)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_texts(df: DataFrame, id_col: str, text_col: str, work: Callable[[pa.Array, list], dict], schema: str, limit: int = 2 << 20) -> DataFrame:
    """Apply ``work(ids, texts) -> columns`` to slices of bounded size; the plan reads only the two columns."""
    names = [x.split()[0] for x in schema.split(",")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, limit):
                made = work(part.column(0), part.column(1).to_pylist())
                if made is None:
                    continue
                columns = [pa.array(made[name], type=arrow.field(name).type) if not isinstance(made[name], (pa.Array, pa.ChunkedArray)) else made[name].cast(arrow.field(name).type) for name in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)

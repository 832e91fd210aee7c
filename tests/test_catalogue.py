"""Every query with SQL beside it must give the same rows as DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, list):
        return str([text(v) for v in x])
    return str(x)


def rows(arrow):
    names = sorted(arrow.column_names)
    return names, sorted("|".join(text(r[n]) for n in names) for r in arrow.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = rows(catalogue.queries()[name](spark, SF).toArrow())
    want = rows(duck.sql(catalogue.oracle_sql()[name]).to_arrow_table())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).toArrow().num_rows > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)

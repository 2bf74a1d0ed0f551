"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import sys

import duckdb
import pytest

import __spark_entry__
from tessera import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(tmp_path_factory):
    c = duckdb.connect()
    for setting in ("memory_limit='2GB'", "max_temp_directory_size='100MB'", f"temp_directory='{tmp_path_factory.mktemp('duck')}'"):
        c.sql(f"SET {setting}")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    expected = sql.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(dict(zip(expected.columns, r))[c]) for c in columns) for r in expected.fetchall()), key=repr)
    assert own == other


def test_entry_point_without_the_training_data_part(monkeypatch):
    """The other queries stay, though the pipeline's file is there."""
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    assert list(__spark_entry__.queries()) == list(queries.QUERIES)
    assert list(__spark_entry__.oracle_sql()) == list(queries.ORACLE_SQL)

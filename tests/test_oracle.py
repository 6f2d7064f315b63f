"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    columns = sorted(df.columns)
    return sorted((str(tuple(r[c] for c in columns)) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    found = duck.sql(queries.ORACLES[name])
    columns, types = list(found.columns), dict(zip(found.columns, map(str, found.types), strict=True))
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert {k: TYPES[v] for k, v in df.dtypes} == types
    order = [columns.index(c) for c in sorted(columns)]
    assert rows(df) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_queries_without_oracle(spark, sf_dir):
    assert queries.QUERIES["image_composite"](spark, sf_dir).count() == 4
    assert queries.QUERIES["image_resize"](spark, sf_dir).first()["width"] == 32
    assert queries.QUERIES["image_split"](spark, sf_dir).count() == 32
    assert queries.QUERIES["png_roundtrip"](spark, sf_dir).where("first_pixel = '323264'").count() == 1
    ledger = queries.QUERIES["chunk_stream_available_now"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ledger.where("status = 'downloaded'").count() == events.where("event_type = 'click'").selectExpr("event_id % 97").distinct().count()

"""Every registered query that has an SQL twin agrees with it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gaugewise.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_twin(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    want = sql.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "category_id", "cd_index", "top_z", "top_feature", "reason_code"]
    assert df.count() == 100


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_l3_of_low_slabs(spark, tmp_path):
    """Slabs of 4 to 13 rows: one segment each, whose edges run down as those of others do, and which may lie below the slab."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id >= 1920").toPandas()
    rows.to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.sql(own.ORACLE_SQL["q_l3"])
    df = own.q_l3(spark, str(tmp_path))
    assert len(want.fetchall()) == 10
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)

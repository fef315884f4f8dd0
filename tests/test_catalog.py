"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from catalog.inputs import evenly_spread
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_one_large_row_group_is_read_by_all_cores(spark, folder):
    path = f"{folder}/events"
    spark.range(40_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spread = evenly_spread(spark.read.parquet(path))
        most = spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spread.count() == 40_000 and most <= 10_000

"""One local session for all tests."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("veilframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A fresh scratch folder."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def lines(spark):
    """A small corpus: three files, one of them clean, one with a null name."""
    rows = [
        ("a", 1, "inet 127.0.0.1/8 /etc/x.y password: /a/b fe80::1 ether 02:00:11:00:00:0A"),
        ("a", 2, "x/etc/x.y 10.0.0.12 10.0.0.1 10.0.0.123"),
        ("a", 3, "10.0.0.12 again, user=bob' and user=bobby"),
        ("a", 3, "10.0.0.12 again, user=bob' and user=bobby"),
        ("b", 1, "nothing to see"),
        ("b", 2, None),
        (None, 1, "10.1.1.1 in a file without a name"),
    ]
    return spark.createDataFrame(rows, "file string, line_no int, line string")


@pytest.fixture
def rows_of():
    """Rows as a sorted list, for comparing frames regardless of order."""

    def collect(df):
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)

    return collect

"""Input tables of the checked queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.shared import fresh_path, spread_out
from veilframe.sources.sinks import write_mirrored
from veilframe.sources.text import scan_text

# A log corpus derived from ``events``; the same text runs in Spark and DuckDB.
LOG_LINES_SQL = """
SELECT concat(event_type, '/u', user_id % 20, '.log') AS file, event_id AS line_no,
  CASE WHEN user_id % 20 = 0 OR event_id % 5 = 0 THEN concat('heartbeat ok seq ', event_id)
  ELSE concat('inet 10.', user_id % 7, '.', event_id % 251, '.', event_id % 13, '/24 ether 02:00:',
    lpad(hex(user_id % 256), 2, '0'), ':00:00:', lpad(hex(event_id % 16), 2, '0'),
    CASE WHEN event_id % 10 = 1 THEN concat(' inet6 fe80::', lower(hex(event_id % 4096)), '/64') ELSE '' END,
    ' file /var/log/', event_type, '/u', user_id, '.log username: u', user_id, ', password=p', event_id % 100) END AS line
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly_spread(df: DataFrame) -> DataFrame:
    """``spread_out`` rows of a table, also if a task of its scan has over twice
    its share of them: a row group is read by one task, and large ones leave
    other tasks without any.  The counts are in the files' footers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(cores) if (most or 0) * cores > 2 * (total or 0) else spread_out(df)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "pages"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = evenly_spread(table(spark, sf_dir, "events"))
    return spark.sql(LOG_LINES_SQL, events=events)


def log_folder(spark: SparkSession, lines: DataFrame, col: str = "line") -> str:
    """The lines as a folder of text files, one directory per log file."""
    path = fresh_path(spark, "logs")
    named = lines.select(F.col("file").alias("rel_path"), "line_no", col)
    write_mirrored(named, path, col, ("line_no",))
    return path


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Such a folder as scanned: each directory is the log it mirrors."""
    return scan_text(spark, path).withColumn("file", F.col("rel_path"))


def quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of which every other one ends in quotes."""
    return log_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("line_no") % 2 == 0, F.concat("line", F.lit("''"))).otherwise(F.col("line"))
    )

"""Row numbers within groups of any size.

A window over the group alone would sort a whole hot file in one task.  Here
the rows are range-partitioned on group and order, so one group may span many
tasks; each task numbers its own slice and adds the rows of earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.shared import written


def rank_within(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1-based position of each row within its group.

    The sliced rows are written to the shared folder, since slice numbers must
    be the same for the numbering and for the slice counts.
    """
    sliced = written(
        df.repartitionByRange(*key, *order).withColumn("_slice", F.spark_partition_id()), "sliced"
    )
    # One row per group and slice, numbered over the few slices of the group.
    before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = sliced.groupBy("_slice", *key).agg(F.count("*").alias("_n"))
    offsets = counts.select(
        F.col("_slice").alias("_o_slice"),
        *[F.col(k).alias(f"_o_{k}") for k in key],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    here = W.partitionBy("_slice", *key).orderBy(*order)
    numbered = sliced.withColumn("_here", F.row_number().over(here))
    same = F.col("_slice") == F.col("_o_slice")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return (
        numbered.join(offsets, same)
        .withColumn(name, (F.col("_here") + F.col("_before")).cast("bigint"))
        .select(*df.columns, name)
    )

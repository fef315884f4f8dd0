"""Joining a small-per-key table to a large one, whatever the key sizes.

The large side may hold a third of its rows under one key (one huge log file,
one line copied everywhere).  The small side has one row per key, but the
number of keys grows with the corpus, so broadcasting needs a size check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.shared import content_bytes, written



def hot_keys(df: DataFrame, key: list[str], counted: DataFrame | None = None) -> DataFrame:
    """``(_hot, _n_salts)``: hashes of the keys that would fill more than one
    shuffle partition, and over how many each is to be spread.

    A key is listed when it holds more than 1/P of the rows, P being the number
    of shuffle partitions; so there are fewer than P of them, whatever the
    data.  Keys sharing a hash are spread together, which changes no result.
    ``counted`` has the rows of each key as ``n``, if they are counted already.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows = F.count("*") if counted is None else F.sum("n")
    counts = (df if counted is None else counted).groupBy(F.xxhash64(*key).alias("_hot")).agg(n_rows.alias("_n"))
    counts = written(counts, "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = F.ceil(F.col("_n") * F.lit(parts) / F.lit(max(total, 1))).cast("int")
    return counts.where(F.col("_n") * parts > total).select("_hot", share.alias("_n_salts"))


def _hashable(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if "map<" not in t and t != "variant"]


def salted_join(
    left: DataFrame, right: DataFrame, key: list[str], how: str, counted: DataFrame | None = None
) -> DataFrame:
    """Null-safe equi-join in which the left side's hot keys are spread over
    many partitions and the matching right rows are repeated for each."""
    hot = F.broadcast(hot_keys(left, key, counted))
    is_hot = F.xxhash64(*key) == F.col("_hot")
    n_salts = F.coalesce("_n_salts", F.lit(1))
    # Spread by content and input partition: stable when a task is rerun, and
    # copies of one row still part, since no input partition holds them all.
    spread = F.xxhash64(F.spark_partition_id(), *_hashable(left))
    salted_left = (
        left.withColumn("_spread", spread)
        .join(hot, is_hot, "left")
        .withColumn("_salt", F.pmod("_spread", n_salts).cast("int"))
        .drop("_spread", "_hot", "_n_salts")
    )
    salted_right = (
        right.join(hot, is_hot, "left")
        .withColumn("_r_salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
        .drop("_hot", "_n_salts")
    )
    condition = _same_key(key) & (F.col("_salt") == F.col("_r_salt"))
    # Told apart from a small table by its content: a scan may look small by its files and grow on the way.
    joined = salted_left.hint("merge").join(_prefixed(salted_right, key), condition, how)
    return _without_key(joined, key).drop("_salt", "_r_salt")


def attach(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    how: str = "left",
    *,
    broadcast_limit: int,
    right_bytes: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``right`` (unique per key, already computed) to ``left``: broadcast
    when its measured content fits the limit, salted shuffle join otherwise."""
    size = content_bytes(right) if right_bytes is None else right_bytes
    if size > broadcast_limit:
        return salted_join(left, right, key, how, counted)
    small = F.broadcast(_prefixed(right, key))
    return _without_key(left.join(small, _same_key(key), how), key)


def _prefixed(right: DataFrame, key: list[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"_r_{k}" for k in key})


def _same_key(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key])


def _without_key(joined: DataFrame, key: list[str]) -> DataFrame:
    return joined.drop(*[f"_r_{k}" for k in key])

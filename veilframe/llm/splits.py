"""Which rows a model may learn from, by a checksum of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """True if crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int, keep: Column, id_col: str = "doc_id") -> DataFrame:
    """``(id, label)`` of at most ``rows`` labelled ids among those that
    ``keep``s, picked by hash; one row per id, the larger label if they differ."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & keep)
    single = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    return single.orderBy(F.xxhash64("id"), "id").limit(rows)


def sampled_texts(df: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, label, text)`` for the ids of a bounded sample, one text per id
    (the smallest, if an id has several); texts of other rows are not moved."""
    found = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = found.join(F.broadcast(sample), "id")
    return found.groupBy("id", "label").agg(F.min("text").alias("text"))

"""From raw documents to token ids: five stages, each written and read again.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept; all but the last return the columns of ``docs``.  Null and
empty texts, repeated rows, null ids and an empty table are treated as the
operator of the stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import bpe, decontaminate, langid, quality, simhash
from veilframe.llm.queries import table, tokenizer
from veilframe.shared import file_system, fresh_path, temporary_tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled for their likeness to labelled good ones stay."""
    return quality.select_rows(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter stay if one language has at least half of theirs."""
    return langid.in_one_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose fingerprints are linked."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, as digests per document."""
    return bpe.digests(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encode),
]

# Learned models, fingerprints and merges have no SQL form; the stages are
# tested against brute force and held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``.

    What a stage writes on its way is deleted when its result is written, and
    that when the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            fs, target = file_system(spark, before)
            fs.delete(target, True)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

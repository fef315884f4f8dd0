"""Masking log files as they arrive: the row-wise rewrites, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.rewriting import mask_kinds, scrub
from veilframe.options import HYBRID, LOW_LEVEL, RIPGREP, Options


def masked_stream(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """Lines of the files in ``path`` and of those still to come, masked in
    line.  There is no state: dictionaries would need the whole file first."""
    if options.strategy in (HYBRID, LOW_LEVEL):
        raise ValueError(f"{options.strategy} needs whole files, a stream has lines only")
    lines = spark.readStream.option("recursiveFileLookup", True).text(path)
    if options.strategy == RIPGREP:
        return mask_kinds(lines, "value", options.loose)
    return scrub(lines, "value", options.strict, options.tokens)


def write_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, exactly once, and stop."""
    return (
        stream.writeStream.format("text")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Text folders as tables of lines; opting out, quarantine and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.joins import attach
from veilframe.shared import file_system, names, written

# Fixed value: a first line holding this marker keeps its file out of the run.
OPT_OUT_MARKER = "-DONT-OBFUSCATE-ME-"

LINE_ORDER = ("part", "block_start", "line_id")

# A file as written by write_mirrored: its escaped name, then a part of it.
_MIRRORED = r"^((?:sink=[^/]*/)?rel_path=([^/]*))/([^/]+)$"


def scan_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A file, or all files below a folder, line by line: ``(rel_path, part,
    source, block_start, line_id, value, line_end)``, and ``file_size`` in bytes.

    Lines end at a newline; a carriage return before it is no part of the value
    but stands in ``line_end``, so that ``value``, ``line_end`` and a newline
    are the bytes of the line.

    Spark splits large files over tasks.  ``line_id`` grows within a task but
    one task may read several blocks of a file, so the order of a file's lines
    is ``LINE_ORDER``.  Folders written by ``write_mirrored`` give the files
    they mirror, however many parts those came in; ``part`` is empty for other
    files.  ``source`` is what holds the file's lines below ``path``: the file,
    or the folder of its parts.  As with every Spark source, names starting with
    ``_`` or ``.`` are mostly not read (``unread_files`` lists them), and
    compressed files are unpacked by their extension.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    below = F.col("_below")
    mirrored = below.rlike(_MIRRORED)
    part = lambda n: F.regexp_extract(below, _MIRRORED, n)
    with_return = F.endswith("value", F.lit("\r"))
    # Cut as bytes, as the line may be no UTF-8.
    without_return = F.substring(F.col("value").cast("binary"), F.lit(1), F.octet_length("value") - 1).cast("string")
    return (
        reader.text(path)
        .select(
            _relative(spark, path, F.col("_metadata.file_path")).alias("_below"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
            F.col("_metadata.file_size").alias("file_size"),
            "value",
        )
        .select(
            F.when(mirrored, _decoded(part(2))).otherwise(below).alias("rel_path"),
            F.when(mirrored, in_written_order(part(3))).otherwise("").alias("part"),
            F.when(mirrored, part(1)).otherwise(below).alias("source"),
            "block_start",
            "line_id",
            "file_size",
            F.when(with_return, without_return).otherwise(F.col("value")).alias("value"),
            F.when(with_return, "\r").otherwise("").alias("line_end"),
        )
    )


def in_written_order(name: Column) -> Column:
    """A part file's name behind its numbers, as wide as they get: Spark writes
    a task's in five digits and a file's in three, or more if these run out."""
    number = lambda regex: F.lpad(F.regexp_extract(name, regex, 1), 10, "0")
    numbered = F.concat_ws("/", number("^part-([0-9]+)"), number(r"^.*[.-]c([0-9]+)(?:\.|$)"), name)
    return F.when(name.rlike("^part-[0-9]"), numbered).otherwise(name)


def _relative(spark: SparkSession, path: str, reported: Column) -> Column:
    """A reported file path below ``path``; the file name if ``path`` is a file."""
    fs, hadoop_path = file_system(spark, path)
    folder = fs.makeQualified(hadoop_path).toUri().getRawPath().rstrip("/") + "/"
    if fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isFile():
        folder = folder[:-1].rpartition("/")[0] + "/"
    at = F.instr(reported, folder)
    return _decoded(F.when(at > 0, F.substr(reported, at + F.lit(len(folder)))).otherwise(reported))


def _decoded(name: Column) -> Column:
    """A name without its percent escapes, among which a plus stands for itself."""
    plain = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(name, F.lit("%")), plain).otherwise(name)


def unread_files(spark: SparkSession, path: str) -> list[str]:
    """Files below a folder that ``scan_text`` gives no line of, relative to
    it: those that Spark's own listing leaves out, and empty ones.  Markers and
    checksums that file systems make are left out.
    """
    fs, root = file_system(spark, path)
    if fs.getFileStatus(root).isFile():
        return []
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    read = {unquote(urlsplit(f).path) for f in spark.read.option("recursiveFileLookup", True).text(path).inputFiles()}
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        whole = status.getPath().toUri().getPath()
        name = whole.rpartition("/")[2]
        made = name == "_SUCCESS" or (name.startswith(".") and name.endswith(".crc"))
        if not made and (whole not in read or status.getLen() == 0):
            found.append(whole[len(base) + 1 :])
    return sorted(found)


def profile_files(lines: DataFrame) -> DataFrame:
    """Profile of a scanned corpus: ``(rel_path, n_bytes, n_lines, size_label)``."""
    parts = lines.groupBy("rel_path", "part").agg(
        F.max("file_size").alias("n_bytes"), F.count(F.lit(1)).alias("n_lines")
    )
    profile = parts.groupBy("rel_path").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_lines").alias("n_lines"))
    return profile.withColumn("size_label", size_label(F.col("n_bytes")))


def file_heads(
    df: DataFrame, key: str | Sequence[str], col: str, order: Sequence[str], *more: Column
) -> DataFrame:
    """``(key…, first_line, n_lines, n_unreadable, is_binary)`` and ``more``;
    each task keeps one candidate per key.  A file with a NUL character is no text."""
    return df.groupBy(*names(key)).agg(
        F.min_by(col, F.struct(*order)).alias("first_line"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(~F.is_valid_utf8(F.col(col)), 1)).alias("n_unreadable"),
        F.coalesce(F.max(F.contains(F.col(col), F.lit("\x00"))), F.lit(False)).alias("is_binary"),
        *more,
    )


def opts_out(first_line: Column, hint: str | None) -> Column:
    """Does a file with this first line, up to a carriage return, stay out of the run?"""
    first_line = F.substring_index(first_line, "\r", 1)
    marked = F.contains(first_line, F.lit(OPT_OUT_MARKER))
    return marked if hint is None else marked | first_line.rlike(hint)


def opt_out(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    order: Sequence[str],
    hint: str | None = None,
    *,
    broadcast_limit: int = 32 * 1024 * 1024,
) -> tuple[DataFrame, DataFrame]:
    """Lines of the files that stay in, and the keys of those that do not."""
    keys = names(key)
    heads = file_heads(df, keys, col, order)
    skipped = written(heads.where(opts_out(F.col("first_line"), hint)).select(*keys), "skipped")
    kept = attach(df, skipped, keys, "left_anti", broadcast_limit=broadcast_limit)
    return kept, skipped


def quarantine(df: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the rest with a ``reason`` instead of the text, as
    raw bytes could hold anything."""
    valid = F.coalesce(F.is_valid_utf8(F.col(col)), F.lit(True))
    bad = df.where(~valid).drop(col).withColumn("reason", F.lit("invalid utf-8"))
    return df.where(valid), bad


def size_label(n_bytes: Column) -> Column:
    """A size in the largest whole binary unit."""
    label = F
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        step = 1024**power
        label = label.when(
            n_bytes >= step,
            F.concat(F.floor(n_bytes / F.lit(step)).cast("string"), F.lit(" " + unit)),
        )
    return label.otherwise(F.concat(n_bytes.cast("string"), F.lit(" B")))


def count_lines(text: Column) -> Column:
    """Lines in a text; a final newline ends a line and starts none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = (text != "") & ~F.endswith(text, F.lit("\n"))
    return (newlines + open_end.cast("int")).cast("bigint")


def profile_texts(df: DataFrame, key: str | Sequence[str], col: str) -> DataFrame:
    """Profile of a text column: ``(key…, n_texts, n_bytes, n_lines, size_label)``."""
    text = F.col(col)
    profile = df.groupBy(*names(key)).agg(
        F.count(text).alias("n_texts"),
        F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(count_lines(text)), F.lit(0)).alias("n_lines"),
    )
    return profile.withColumn("size_label", size_label(F.col("n_bytes")))

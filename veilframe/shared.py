"""Storage every executor can reach, for results that are needed twice.

Written tables rather than cached blocks: they survive lost executors, and
their size can be measured before a join strategy is chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the one set on the
    context; in local mode without either, a fresh temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end, also of a failed run, what was written to the shared
    folder inside: such tables hold lines, segments and their tokens in clear.
    Results that read them have to be acted on inside."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            fs, target = file_system(spark, path)
            fs.delete(target, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def dropped(*frames: DataFrame) -> None:
    """Delete tables that :func:`written` returned and nothing reads any more."""
    for frame in frames:
        fs, target = file_system(frame.sparkSession, _paths.pop(frame))
        fs.delete(target, True)


def spread_out(df: DataFrame) -> DataFrame:
    """Rows of a scan that has fewer tasks than the cluster has cores (a few
    unsplittable files, say) over all cores; any other scan as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def names(key: str | Sequence[str]) -> list[str]:
    """A key given as one name or several, as a list."""
    return [key] if isinstance(key, str) else list(key)


def row_bytes(df: DataFrame) -> Column:
    """Size of a row's content: strings by their bytes, nested values by their
    JSON text, anything else as eight bytes, and a few for the row itself."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "string":
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif "<" in kind:
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + F.lit(8)
    return size.cast("bigint")


def content_bytes(df: DataFrame) -> int:
    """Size of a frame's content, measured."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("n")).first()["n"]

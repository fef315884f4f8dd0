"""Writing masked corpora: mirrored below a new folder, or in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.shared import file_system
from veilframe.sources.text import LINE_ORDER, in_written_order, scan_text

PATH_COLUMN = "rel_path"
SINK_COLUMN = "sink"


def placed(df: DataFrame, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """The rows dealt out by file and line order, so that the lines of a file,
    read by partition, are in order and one large file spreads over many tasks.

    Dealing samples what lies below it: place lines before they are masked.
    """
    return df.repartitionByRange(PATH_COLUMN, *order)


def write_mirrored(
    df: DataFrame,
    out: str,
    col: str = "value",
    order: Sequence[str] = LINE_ORDER,
    fmt: str = "text",
    at_write: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    is_placed: bool = False,
) -> None:
    """One directory per input file (``rel_path=…``) below ``out``.

    ``text`` output has a file's lines in order, read by part-file name; rows
    are placed first unless they are already.  ``parquet`` output keeps the
    order columns instead and needs no shuffle.  A column ``sink`` adds a
    directory level above, and text gets each row's ``line_end``, if there is
    such a column.  ``at_write`` is applied to the rows as they are written.
    """
    levels = [c for c in (SINK_COLUMN, PATH_COLUMN) if c in df.columns]
    if fmt == "parquet":
        rows = df.select(*levels, *order, F.col(col).alias("value"))
        at_write(rows).write.partitionBy(*levels).parquet(out)
        return
    if fmt != "text":
        raise ValueError(f"format must be text or parquet, got {fmt!r}")
    in_order = (df if is_placed else placed(df, order)).sortWithinPartitions(*levels, *order)
    value = F.concat(F.col(col), F.col("line_end")) if "line_end" in df.columns else F.col(col)
    rows = in_order.select(*levels, value.alias("value"))
    at_write(rows).write.partitionBy(*levels).text(out)


def read_mirrored(spark: SparkSession, path: str) -> DataFrame:
    """Mirrored text, ``(rel_path, part, block_start, line_id, value)``; line
    order within a file is ``(part, block_start, line_id)``."""
    return (
        spark.read.schema(f"value string, {PATH_COLUMN} string")
        .text(path)
        .select(
            PATH_COLUMN,
            in_written_order(F.col("_metadata.file_name")).alias("part"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
            "value",
        )
    )


def replace_in_place(
    spark: SparkSession,
    path: str,
    transform: Callable[[DataFrame], DataFrame],
    *,
    remove_original: bool = False,
    col: str = "value",
    at_write: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    is_placed: bool = False,
    files: Mapping[str, tuple[int, list[str]]] | None = None,
) -> str | None:
    """Rewrite the files of a text folder where they are.

    ``transform`` gets the scanned lines and returns those of the ``files`` to
    be replaced (name: lines and sources, as scanned; by default all).  Their
    rewritten lines go to a staging folder next to ``path``.  Only when it has
    all those files, with as many lines as were read, is a journal written, and
    then each file is swapped: the original goes to the folder whose name is
    returned (or away, with ``remove_original``), the rewritten one takes its
    place as ``rel_path=…``.  Files that are not replaced are not touched.

    A run that broke down is finished, if its journal was written, or else
    undone by ``recover_in_place``, which the next run calls first.
    """
    path = path.rstrip("/")
    recover_in_place(spark, path)
    tag = uuid.uuid4().hex
    staged, original = f"{path}.staged-{tag}", f"{path}.original-{tag}"
    lines = scan_text(spark, path)
    if files is None:
        found = lines.groupBy(PATH_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.collect_set("source").alias("sources"))
        files = {r[PATH_COLUMN]: (r["n"], r["sources"]) for r in found.toLocalIterator()}
    seen = Observation()

    def counted(rows: DataFrame) -> DataFrame:
        return at_write(rows).observe(seen, F.count(F.lit(1)).alias("n"))

    write_mirrored(transform(lines), staged, col, at_write=counted, is_placed=is_placed)
    n_in, n_out = sum(n for n, _ in files.values()), seen.get["n"]
    units = _units(spark, staged)
    if n_in != n_out or units.keys() != files.keys():
        raise RuntimeError(f"{n_in} lines read but {n_out} written, of {len(files)} and {len(units)} files, kept {path} and {staged}")
    fs, root = file_system(spark, path)
    below = (lambda source: path) if fs.getFileStatus(root).isFile() else (lambda source: f"{path}/{source}")
    swaps = [
        {"from": [[below(s), f"{original}/{s}"] for s in files[name][1]], "to": [f"{staged}/{unit}", f"{path}/{unit}"]}
        for name, unit in units.items()
    ]
    journal = f"{path}.swap-{tag}"
    _write_journal(spark, journal, {"staged": staged, "original": original, "remove": remove_original, "swaps": swaps})
    _finish(spark, journal)
    return None if remove_original or not files else original


def recover_in_place(spark: SparkSession, path: str) -> None:
    """Finish what a broken run in place had written down, and delete what it
    had staged before that."""
    path = path.rstrip("/")
    fs, root = file_system(spark, path)
    parent = root.getParent()
    if parent is None or not fs.exists(parent):
        return
    names = {s.getPath().getName(): str(s.getPath()) for s in fs.listStatus(parent)}
    own = f"{root.getName()}."
    for name, journal in names.items():
        if name.startswith(f"{own}swap-") and not name.endswith(".part"):
            _finish(spark, journal)
    for name, found in names.items():
        if name.startswith((f"{own}staged-", f"{own}swap-")) and fs.exists(file_system(spark, found)[1]):
            fs.delete(file_system(spark, found)[1], True)


def _units(spark: SparkSession, folder: str) -> dict[str, str]:
    """The files that a folder of mirrored text holds, with the folder of each."""
    fs, root = file_system(spark, folder)
    found = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{SINK_COLUMN}="):
            found |= {f: f"{name}/{unit}" for f, unit in _units(spark, f"{folder}/{name}").items()}
        elif name.startswith(f"{PATH_COLUMN}="):
            found[unquote(name.removeprefix(f"{PATH_COLUMN}="))] = name
    return found


def _write_journal(spark: SparkSession, journal: str, content: dict) -> None:
    """All of it or nothing: renamed when it is complete."""
    fs, target = file_system(spark, f"{journal}.part")
    stream = fs.create(target)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    _rename(spark, f"{journal}.part", journal)


def _finish(spark: SparkSession, journal: str) -> None:
    """Do what is left of a journal's swaps; each step can be done again."""
    fs, target = file_system(spark, journal)
    stream = fs.open(target)
    content = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()

    def swap(one: dict) -> None:
        source, target = one["to"]
        if not _exists(spark, source):
            return  # done before
        for old, kept in one["from"]:
            if _exists(spark, old) and not _exists(spark, kept):
                _move(spark, old, kept)
        _move(spark, source, target)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(swap, content["swaps"]))
    for folder in (content["staged"], *([content["original"]] if content["remove"] else []), journal):
        fs, target = file_system(spark, folder)
        fs.delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, to_path = file_system(spark, target)
    fs.mkdirs(to_path.getParent())
    _rename(spark, source, target)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, from_path = file_system(spark, source)
    if not fs.rename(from_path, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise RuntimeError(f"could not rename {source} to {target}")

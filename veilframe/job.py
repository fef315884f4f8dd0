"""Masking a folder as a Spark job: ``spark-submit veilframe/job.py -i logs -o masked``.

The repository must be on PYTHONPATH.  Cluster size, parallelism and logging are
Spark's own settings.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from veilframe.options import STRATEGIES, Options
from veilframe.plans.folder import run_folder


def _at_least_one(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError(f"must be at least 1, got {value}")
    return value


def parser() -> argparse.ArgumentParser:
    defaults = Options()
    p = argparse.ArgumentParser(prog="veilframe", description="Mask sensitive segments in text files")
    p.add_argument("-i", "--input", required=True, help="file or folder to mask")
    p.add_argument("-o", "--output", help="new folder for the result; in place when not given")
    p.add_argument("-s", "--salt", default=defaults.salt)
    p.add_argument("--strategy", choices=STRATEGIES, default=defaults.strategy)
    p.add_argument(
        "-m",
        "--min-split-size-in-bytes",
        type=_at_least_one,
        default=defaults.min_split_bytes,
        help="for tables with large cells; the lines of a folder are never that long in practice",
    )
    p.add_argument("-q", "--quarantine", help="folder that lists unreadable lines; next to the output when not given")
    p.add_argument("-rm", "--remove-original", action="store_true", help="for in-place runs")
    p.add_argument("--ignore-hint", help="pattern on the first line of files to leave alone")
    p.add_argument(
        "--threshold",
        type=_at_least_one,
        default=defaults.threshold,
        help="distinct segments from which a file is scrubbed in line",
    )
    return p


def options_of(args: argparse.Namespace) -> Options:
    return Options(
        strategy=args.strategy,
        salt=args.salt,
        threshold=args.threshold,
        min_split_bytes=args.min_split_size_in_bytes,
        ignore_hint=args.ignore_hint,
        remove_original=args.remove_original,
    )


def main(argv: Sequence[str] | None = None) -> str:
    """Run the job; returns and prints its status."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    run = run_folder(spark, args.input, args.output, options_of(args), quarantine_path=args.quarantine)
    (row,) = run.summary.collect()
    print(row.asDict(), run.timing or "", *(f"\nnot read: {name}" for name in run.unread))
    return row["status"]


if __name__ == "__main__":
    main()

"""Arguments and a whole run of the job."""

from __future__ import annotations

import os

import pytest

from veilframe.job import main, options_of, parser

GOOD = ["-i", "logs", "-o", "masked", "-s", "pepper"]


def test_defaults():
    args = parser().parse_args(GOOD)
    options = options_of(args)
    assert (args.input, args.output, args.quarantine) == ("logs", "masked", None)
    assert (options.salt, options.strategy, options.threshold) == ("pepper", "HYBRID", 200)
    assert (options.ignore_hint, options.remove_original) == (None, False)


@pytest.mark.parametrize(
    "argv",
    [
        [],
        [*GOOD, "--colour"],
        [*GOOD, "--strategy", "FASTEST"],
        [*GOOD, "-m", "none"],
        [*GOOD, "--min-split-size-in-bytes", "0"],
        [*GOOD, "--threshold", "-1"],
    ],
)
def test_bad_arguments(argv):
    with pytest.raises(SystemExit) as stopped:
        parser().parse_args(argv)
    assert stopped.value.code == 2


def test_run(spark, folder):
    source = os.path.join(folder, "in")
    os.makedirs(source)
    with open(os.path.join(source, "x.log"), "w") as f:
        f.write("inet 127.0.0.1/8\nplain\n")
    out = os.path.join(folder, "out")
    assert main(["-i", source, "-o", out, "--strategy", "LOW_LEVEL"]) == "SUCCESS"
    got = spark.read.text(os.path.join(out, "rel_path=x.log")).collect()
    assert [r["value"] for r in got] == ["inet {{IPV4-e56ea}}/8", "plain"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        main(["-i", os.path.join(folder, "missing"), "-o", out])

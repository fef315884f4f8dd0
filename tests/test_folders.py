"""Text folders: scanning, opting out, quarantine, parts, writing, whole runs."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import brute
from catalog import queries
from catalog.inputs import LOG_LINES_SQL
from veilframe import Options
from veilframe.detectors import strict_profile
from veilframe.functions.tokens import TokenRule
from veilframe.operators.parts import ROW_ID, merge_rows, parts_of, split_rows
from veilframe.operators.rewriting import scrub
from veilframe.plans.folder import run_folder
from veilframe.plans.summary import observed, run_summary, timed
from veilframe.shared import shared_folder
from veilframe.sources import sinks
from veilframe.sources.sinks import read_mirrored, replace_in_place, write_mirrored
from veilframe.sources.text import (
    LINE_ORDER,
    count_lines,
    opt_out,
    profile_files,
    profile_texts,
    quarantine,
    scan_text,
    size_label,
)
from veilframe.streaming.logs import masked_stream, write_available

FILES = {
    "plain.log": b"tea\ncoffee\ntea\nwater\n",
    "deep/er/no_extension": b"one line without an end",
    "folder 1/b+c/ein%20 b.log": b"inet 127.0.0.1/8\n/srv/mail/in\nuser: eve, token=Zx9 q7\n",
    "marked.log": b"-DONT-OBFUSCATE-ME-\nhello\n/srv/mail/in\nuser: eve, token=Zx9 q7\n",
    "hinted.log": b"#raw\n\n/srv/mail/in\nuser: eve, token=Zx9 q7\n",
}
HINT = "^#raw"
STRICT, TOKENS = strict_profile(), TokenRule()


def write_files(folder, files):
    for name, content in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
    return folder


@pytest.fixture
def corpus(folder):
    return write_files(os.path.join(folder, "logs in"), FILES)


def by_file(df, order=LINE_ORDER):
    files = {}
    for r in df.orderBy("rel_path", *order).collect():
        files.setdefault(r["rel_path"], []).append(r["value"])
    return files


def as_lines(files):
    return {n: c.decode().removesuffix("\n").split("\n") for n, c in files.items()}


def test_scan_a_nested_folder(spark, corpus):
    assert by_file(scan_text(spark, corpus)) == as_lines(FILES)


def test_scan_one_file(spark, corpus):
    got = by_file(scan_text(spark, os.path.join(corpus, "plain.log")))
    assert got == as_lines({"plain.log": FILES["plain.log"]})


def test_scan_with_a_name_pattern(spark, corpus):
    assert set(by_file(scan_text(spark, corpus, glob="*.log"))) == set(FILES) - {"deep/er/no_extension"}


def test_input_must_exist(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_text(spark, os.path.join(folder, "missing"))


def test_line_order_of_a_split_file(spark, folder):
    content = "".join(f"line {i}\n" for i in range(20000)).encode()
    path = write_files(os.path.join(folder, "big"), {"x.log": content})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10000)
    try:
        lines = scan_text(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        assert by_file(lines) == as_lines({"x.log": content})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("hint, skipped", [(None, {"marked.log"}), (HINT, {"marked.log", "hinted.log"})])
@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_opt_out(spark, corpus, hint, skipped, broadcast):
    kept, out = opt_out(
        scan_text(spark, corpus), "rel_path", "value", LINE_ORDER, hint, broadcast_limit=broadcast
    )
    assert {r["rel_path"] for r in out.collect()} == skipped
    assert by_file(kept) == {n: t for n, t in as_lines(FILES).items() if n not in skipped}


def test_hint_counts_on_the_first_line_only(spark, folder):
    path = write_files(os.path.join(folder, "h"), {"x.log": b"first\n-NoObf4Me-\n-DONT-OBFUSCATE-ME-\n"})
    kept, out = opt_out(scan_text(spark, path), "rel_path", "value", LINE_ORDER, HINT)
    assert out.count() == 0 and kept.count() == 3


def test_quarantine(spark, folder):
    path = write_files(os.path.join(folder, "q"), {"x.log": b"ok\n\xff\xfe 10.0.0.1\nfine\n"})
    good, bad = quarantine(scan_text(spark, path))
    assert [r["value"] for r in good.orderBy(*LINE_ORDER).collect()] == ["ok", "fine"]
    (row,) = bad.collect()
    assert (row["rel_path"], row["reason"]) == ("x.log", "invalid utf-8")
    assert "value" not in bad.columns


def test_profiles(spark, corpus):
    got = {r["rel_path"]: (r["n_bytes"], r["n_lines"]) for r in profile_files(scan_text(spark, corpus)).collect()}
    assert got == {n: (len(c), len(as_lines(FILES)[n])) for n, c in FILES.items()}
    df = spark.createDataFrame([("x", "é\nb\n"), ("x", ""), ("x", None), ("y", None)], "k string, t string")
    rows = {r["k"]: (r["n_texts"], r["n_bytes"], r["n_lines"]) for r in profile_texts(df, "k", "t").collect()}
    assert rows == {"x": (2, 5, 2), "y": (0, 0, 0)}


def test_size_labels(spark):
    sizes = [0, 1023, 1024, 2**20 - 1, 2**20, 3 * 2**30 + 5, 2**40]
    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    got = [r[0] for r in df.select(size_label(F.col("n"))).collect()]
    assert got == ["0 B", "1023 B", "1 KB", "1023 KB", "1 MB", "3 GB", "1 TB"]


TEXTS = ["", "one", "a\nb", "a\nb\n", "\n", "\n\n\n", "a\n\nb\nc\nd\ne\nf", "x" * 50, "\na", None]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_split_and_merge_give_the_text_back(spark, n, rows_of):
    # Keys repeat on purpose: parts belong to rows, not to keys.
    df = spark.createDataFrame([("k" if i % 2 else None, t) for i, t in enumerate(TEXTS)], "k string, text string")
    parts = split_rows(df, "k", "text", n, 1)
    assert parts.groupBy(ROW_ID).count().agg(F.max("count")).first()[0] <= n
    assert rows_of(merge_rows(parts.repartition(5), "k")) == rows_of(df)


def test_part_numbers_follow_line_numbers(spark):
    text = "\n".join(str(i) for i in range(10))
    df = spark.createDataFrame([(text,)], "t string").select(parts_of(F.col("t"), 3, 1).alias("p"))
    expected = ["\n".join(str(i) for i in range(10) if i * 3 // 10 == part) for part in range(3)]
    assert df.first()["p"] == expected
    count = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(count_lines(F.col("t")).alias("n"))
    assert [r["n"] for r in count.collect()] == [None if t is None else len(t.splitlines()) for t in TEXTS]


@pytest.mark.parametrize("fmt", ["text", "parquet"])
def test_mirrored_output(spark, corpus, folder, fmt):
    out = os.path.join(folder, "out")
    write_mirrored(scan_text(spark, corpus), out, fmt=fmt)
    if fmt == "text":
        got = by_file(read_mirrored(spark, out), ("part", "block_start", "line_id"))
    else:
        schema = "part string, block_start long, line_id long, value string, rel_path string"
        got = by_file(spark.read.schema(schema).parquet(out))
    assert got == as_lines(FILES)
    with pytest.raises(ValueError):
        write_mirrored(scan_text(spark, corpus), out, fmt="pdf")


def test_mirrored_lines_of_a_large_file_stay_in_order(spark, folder):
    content = "".join(f"line {i}\n" for i in range(30000)).encode()
    path = write_files(os.path.join(folder, "big"), {"x.log": content, "y.log": b"y\n"})
    out = os.path.join(folder, "out")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        write_mirrored(scan_text(spark, path), out)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(os.listdir(os.path.join(out, "rel_path=x.log"))) > 4
    got = by_file(read_mirrored(spark, out), ("part", "block_start", "line_id"))
    assert got == as_lines({"x.log": content, "y.log": b"y\n"})


def test_parts_are_read_in_the_order_they_were_written(spark, folder):
    names = [f"part-{task:05d}-0c1a-c00000000009.c{n:03d}.txt" for task in (99999, 100000) for n in (0, 999, 1000)]
    write_files(folder, {f"rel_path=x.log/{name}": f"line {i}\n".encode() for i, name in enumerate(names)})
    expected = as_lines({"x.log": "".join(f"line {i}\n" for i in range(len(names))).encode()})
    assert by_file(scan_text(spark, folder)) == expected
    assert by_file(read_mirrored(spark, folder), ("part", "block_start", "line_id")) == expected


def test_rescanned_parts_do_not_grow_in_number(spark, monkeypatch):
    counts = []
    for n in (5_000, 20_000):
        rows = "id AS event_id, 0L AS user_id, 'view' AS event_type"
        monkeypatch.setattr(queries, "log_lines", lambda s, d, n=n: s.sql(LOG_LINES_SQL, events=s.range(n).selectExpr(*rows.split(", "))))
        before = set(os.listdir(shared_folder(spark)))
        result = queries.a1_rescan_mirrored(spark, "")
        assert [r["nth"] for r in result.where("line LIKE '%seq 4321'").collect()] == [4322]
        (path,) = [p for p in set(os.listdir(shared_folder(spark))) - before if p.startswith("parts-")]
        counts.append(sum(f.endswith(".txt") for _, _, fs in os.walk(os.path.join(shared_folder(spark), path)) for f in fs))
    assert 500 < counts[0] and counts[1] < 2_100


@pytest.mark.parametrize("remove", [False, True])
def test_replace_in_place(spark, corpus, remove):
    kept = replace_in_place(
        spark, corpus, lambda df: scrub(df, "value", STRICT, TOKENS), remove_original=remove
    )
    got = by_file(read_mirrored(spark, corpus), ("part", "block_start", "line_id"))
    assert got == {n: [brute.scrub(t, STRICT) for t in ts] for n, ts in as_lines(FILES).items()}
    if remove:
        assert kept is None and len(os.listdir(os.path.dirname(corpus))) == 1
    else:
        assert by_file(scan_text(spark, kept)) == as_lines(FILES)


def test_replace_in_place_loses_no_line(spark, corpus):
    with pytest.raises(RuntimeError, match="lines read"):
        replace_in_place(spark, corpus, lambda df: df.where("value <> 'coffee'"))
    assert by_file(scan_text(spark, corpus)) == as_lines(FILES)


def test_run_summary(spark, corpus):
    lines = scan_text(spark, corpus)
    (row,) = run_summary(lines, "rel_path", "value", LINE_ORDER, Options(ignore_hint=HINT)).collect()
    assert row.asDict() == {
        "files_seen": 5, "opted_out": 2, "not_text": 0, "untouched": 2, "rewritten": 1, "quarantined_lines": 0,
        "n_file_dir": 1, "n_credentials": 2, "n_mac_addr": 0, "n_ipv4": 1, "n_ipv6": 0, "status": "SUCCESS",
    }
    (row,) = run_summary(lines, "rel_path", "value", LINE_ORDER, Options(ignore_hint=".")).collect()
    assert (row["files_seen"], row["opted_out"], row["status"]) == (5, 5, "IGNORED")
    (row,) = run_summary(lines.where("false"), "rel_path", "value", LINE_ORDER, Options()).collect()
    assert (row["files_seen"], row["status"]) == (0, "IGNORED")


def test_summary_of_unreadable_lines(spark, folder):
    """A first line decides about its file even when it cannot be read."""
    files = {"bad.log": b"\xff\n", "late.log": b"\xff\n-DONT-OBFUSCATE-ME-\n/x\n"}
    lines = scan_text(spark, write_files(os.path.join(folder, "u"), files))
    (row,) = run_summary(lines, "rel_path", "value", LINE_ORDER, Options()).collect()
    assert (row["files_seen"], row["opted_out"], row["quarantined_lines"]) == (2, 0, 2)
    assert (row["untouched"], row["rewritten"], row["n_file_dir"]) == (1, 1, 1)


def test_timing(spark):
    df = spark.range(1000).selectExpr("'é' AS t")
    seen = timed(lambda o: observed(df, "t", o).write.format("noop").mode("overwrite").save())
    assert (seen.rows, seen.text_bytes) == (1000, 2000) and seen.seconds > 0


def test_run_over_a_folder(spark, corpus, folder):
    out = os.path.join(folder, "out")
    run = run_folder(spark, corpus, out, Options(strategy="IN_PLACE", ignore_hint=HINT))
    got = by_file(read_mirrored(spark, out), ("part", "block_start", "line_id"))
    expected = {
        n: [brute.scrub(t, STRICT) for t in ts]
        for n, ts in as_lines(FILES).items()
        if n not in ("marked.log", "hinted.log")
    }
    assert got == expected
    assert run.summary.first()["status"] == "SUCCESS" and run.quarantined.count() == 0
    assert run.timing.rows == sum(map(len, expected.values()))


def test_run_in_place_keeps_opted_out_files(spark, corpus):
    run = run_folder(spark, corpus, options=Options(strategy="RIPGREP", remove_original=True))
    got = by_file(scan_text(spark, corpus))
    assert got["marked.log"] == as_lines(FILES)["marked.log"]
    assert got["hinted.log"][2:] == ["{{FILE-DIR}}", "{{CREDENTIALS}}, {{CREDENTIALS}} q7"]
    assert run.kept_original is None and run.summary.first()["opted_out"] == 1


def test_run_in_place_stops_on_unreadable_lines(spark, folder):
    path = write_files(os.path.join(folder, "q"), {"x.log": b"ok\n\xff\n"})
    with pytest.raises(RuntimeError):
        run_folder(spark, path, options=Options(strategy="IN_PLACE"))
    assert os.listdir(path) == ["x.log"]


HIDDEN = {"_conf.log": b"/a/b 10.0.0.1\n", ".env": b"token=1\n", "empty.log": b"", "sub/_d/y.log": b"/x\n", ".x/z": b""}


def tree(folder):
    """Files below a folder with their content, without what Spark adds."""
    found = {}
    for at, _, names in os.walk(folder):
        for name in names:
            if name != "_SUCCESS" and not name.endswith(".crc"):
                path = os.path.join(at, name)
                with open(path, "rb") as f:
                    found[os.path.relpath(path, folder)] = f.read()
    return found


SENSITIVE = b"/srv/x\r\n10.0.0.1 \xc3\xa9\nno end /srv/y"
LEFT = HIDDEN | {
    "image.bin": b"\x00\x01\r\x02\r\n\x03 /srv/x\n10.0.0.1\n",
    "returns.log": b"one\r\ntwo\r\n\r\nthree",
    "old mac.log": b"one\rtwo\rthree\r",
    "marked.log": b"-DONT-OBFUSCATE-ME-\r\n/srv/x\r\n10.0.0.1",
    "sub/y.log._COPYING_": b"/srv/x\n",
    "bom.log": b"\xef\xbb\xbfplain\n",
}


@pytest.mark.parametrize("strategy", ["IN_PLACE", "LOW_LEVEL", "HYBRID", "HYBRID_SPLIT"])
def test_run_in_place_touches_only_what_it_masks(spark, folder, strategy):
    """Every file is masked, or as it was, and none is both."""
    path = write_files(os.path.join(folder, "in"), LEFT | {"x.log": SENSITIVE, "_x=1.log": b"/srv/x\n", "deep/er/z": b"10.0.0.1"})
    for n in range(2):
        run = run_folder(spark, path, options=Options(strategy=strategy, remove_original=True))
        assert run.unread == sorted([*HIDDEN, "sub/y.log._COPYING_"])
        got = tree(path)
        assert {name: c for name, c in got.items() if "rel_path=" not in name} == LEFT
        files = by_file(scan_text(spark, path))
        assert {"x.log", "_x=1.log", "deep/er/z"} <= files.keys() and not any("/srv" in v for v in files["x.log"] + files["_x=1.log"])
        parts = {name: c for name, c in got.items() if "rel_path=x.log" in name}
        masked = b"".join(parts[name] for name in sorted(parts))
        if not n:
            assert masked.count(b"\r\n") == 1 and masked.count(b"\n") == 3 and b" \xc3\xa9\n" in masked
            row = run.summary.first()
            assert (row["opted_out"], row["not_text"], row["rewritten"]) == (1, 1, 3)
    assert os.listdir(folder) == ["in"]


def test_run_in_place_on_one_file(spark, folder):
    write_files(folder, {"x.log": b"/srv/x\n", "y.log": b"/srv/y\n"})
    path = os.path.join(folder, "x.log")
    run = run_folder(spark, path, options=Options(strategy="IN_PLACE"))
    assert by_file(scan_text(spark, path))["x.log"][0].startswith("{{FILE-DIR-")
    assert tree(run.kept_original) == {"x.log": b"/srv/x\n"}
    assert tree(folder)["y.log"] == b"/srv/y\n"


class Broken(Exception):
    pass


@pytest.mark.parametrize("remove", [False, True])
def test_a_broken_run_in_place_is_finished_or_undone(spark, folder, monkeypatch, remove):
    """The run is stopped before each of its renames; the next call mends it."""
    files = LEFT | {"x.log": b"/srv/x\n", "deep/z.log": b"10.0.0.1\n", "u.log": b"/srv/u\n"}
    rename = sinks._rename
    for stop in range(9):
        path = write_files(os.path.join(folder, f"in{stop}"), files)
        done = []

        def breaking(spark, source, target, stop=stop, done=done):
            if len(done) >= stop:
                raise Broken
            done.append(target)
            rename(spark, source, target)

        monkeypatch.setattr(sinks, "_rename", breaking)
        broken = False
        try:
            run_folder(spark, path, options=Options(strategy="IN_PLACE", remove_original=remove))
        except Broken:
            broken = True
        monkeypatch.setattr(sinks, "_rename", rename)
        sinks.recover_in_place(spark, path)
        got = tree(path)
        assert {n: c for n, c in got.items() if n in LEFT} == LEFT
        masked = {n for n in by_file(scan_text(spark, path)) if f"{n}" not in got}
        assert masked == (set() if stop == 0 else {"x.log", "deep/z.log", "u.log"}), stop
        if stop == 0:
            assert got == files
        left = [n for n in os.listdir(folder) if n.startswith(f"in{stop}.")]
        assert len(left) == (0 if remove or stop == 0 else 1), left
        assert broken == (stop < 7)


def test_unread_files_are_not_copied_to_a_new_folder(spark, folder):
    path = write_files(os.path.join(folder, "in"), HIDDEN | {"x.log": b"/srv/x\n"})
    run = run_folder(spark, path, os.path.join(folder, "out"), Options(strategy="IN_PLACE"))
    assert run.unread == sorted(HIDDEN)
    assert by_file(scan_text(spark, os.path.join(folder, "out"))).keys() == {"x.log"}


def test_layout_survives_reading_again(spark, folder):
    content = "".join(f"line {i} of /srv/{i}\n" for i in range(4000)).encode()
    path = write_files(os.path.join(folder, "in"), {"d 1/x+y%20.log": content, "off.log": b"-DONT-OBFUSCATE-ME-\n/srv/x\n" * 900})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for strategy in ("IN_PLACE", "LOW_LEVEL", "HYBRID_SPLIT", "HYBRID"):
            run_folder(spark, path, options=Options(strategy=strategy, remove_original=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = by_file(scan_text(spark, path))
    assert got["d 1/x+y%20.log"] == [brute.scrub(t, STRICT) for t in as_lines({"x": content})["x"]]
    # Opted out by its first line, although later parts do not hold it.
    assert got["off.log"] == ["-DONT-OBFUSCATE-ME-", "/srv/x"] * 900
    assert got.keys() == {"d 1/x+y%20.log", "off.log"}
    assert len([n for n in os.listdir(path) if n.startswith("rel_path=")]) == 1
    assert tree(path)["off.log"] == b"-DONT-OBFUSCATE-ME-\n/srv/x\n" * 900


def test_unreadable_lines_are_listed(spark, folder):
    path = write_files(os.path.join(folder, "in"), {"x.log": b"ok\n\xff\xfe /srv\nfine\n", "y.log": b"\xff\n"})
    out = os.path.join(folder, "out")
    run = run_folder(spark, path, out, Options(strategy="IN_PLACE"))
    listed = spark.read.parquet(out + ".quarantine")
    assert sorted(r["rel_path"] for r in listed.collect()) == ["x.log", "y.log"]
    assert run.quarantined.count() == run.summary.first()["quarantined_lines"] == 2
    assert by_file(scan_text(spark, out)) == {"x.log": ["ok", "fine"]}


@pytest.mark.parametrize("strategy", ["IN_PLACE", "LOW_LEVEL", "HYBRID"])
def test_nothing_in_clear_stays_behind(spark, corpus, folder, strategy):
    shared = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    run_folder(spark, corpus, os.path.join(folder, "out"), Options(strategy=strategy, max_inline_entries=1))
    with pytest.raises(Exception, match="(?i)exists"):
        run_folder(spark, corpus, os.path.join(folder, "out"), Options(strategy=strategy))
    assert set(os.listdir(shared)) == before


def test_summary_counts_by_the_profile_of_the_run(spark):
    df = spark.createDataFrame([("f", 1, "x 1.2.3.4port"), ("g", 1, "x 1.2.3.4")], "rel_path string, n int, value string")
    counts = {}
    for strategy in ("IN_PLACE", "LOW_LEVEL", "HYBRID", "RIPGREP"):
        (row,) = run_summary(df, "rel_path", "value", ["n"], Options(strategy=strategy)).collect()
        counts[strategy] = (row["untouched"], row["rewritten"], row["n_ipv4"])
    assert counts == {"IN_PLACE": (1, 1, 1), "LOW_LEVEL": (0, 2, 2), "HYBRID": (0, 2, 2), "RIPGREP": (0, 2, 2)}
    (row,) = run_summary(df, "rel_path", "value", ["n"], Options(threshold=1)).collect()
    assert (row["untouched"], row["rewritten"], row["n_ipv4"]) == (1, 1, 1)


def test_a_folder_run_reads_its_input_few_times(spark, folder):
    """Input records of all stages of a run, from Spark's own metrics."""
    path = write_files(os.path.join(folder, "in"), {f"{n}.log": b"user eve at /srv/x 10.0.0.1\n" * 500 for n in range(8)})
    tracker = spark.sparkContext._jsc.sc().statusStore()
    def read():
        stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))
    for strategy, output, limit in (("IN_PLACE", True, 4), ("HYBRID", True, 6), ("IN_PLACE", False, 4)):
        before = read()
        run_folder(spark, path, os.path.join(folder, f"out-{strategy}") if output else None, Options(strategy=strategy, remove_original=True))
        assert read() - before < limit * 4200, strategy


def test_streams_refuse_what_needs_whole_files(spark, folder):
    for strategy in ("HYBRID", "LOW_LEVEL"):
        with pytest.raises(ValueError, match="whole files"):
            masked_stream(spark, folder, Options(strategy=strategy))


def test_stream_of_files(spark, folder):
    source = write_files(os.path.join(folder, "in"), {"1.log": b"inet 127.0.0.1/8\n"})
    out, state = os.path.join(folder, "out"), os.path.join(folder, "state")
    for strategy, more in (("IN_PLACE", b"plain\n"), ("IN_PLACE", b"::1 /x\n")):
        stream = masked_stream(spark, source, Options(strategy=strategy))
        write_available(stream, out, state).awaitTermination()
        write_files(source, {f"{len(os.listdir(source)) + 1}.log": more})
    got = sorted(r["value"] for r in spark.read.text(out).collect())
    assert got == ["inet {{IPV4-e56ea}}{{FILE-DIR-4ff67}}", "plain"]


def test_shared_folder_comes_from_the_session(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if setting:
        assert shared_folder(spark) == setting.rstrip("/")
    else:
        assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_shared_folder_without_a_setting():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.sparkContext.folder
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://somewhere:7077"))

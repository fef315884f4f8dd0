"""Accept and reject lists of the strict patterns, in Spark and in DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.detectors import (
    CREDENTIAL_KEYWORDS,
    CREDENTIALS,
    FILE_DIR,
    IPV4,
    IPV6,
    MAC_ADDR,
    Detector,
    credentials_pattern,
    keyword_stems,
    loose_profile,
    pick,
    strict_profile,
    with_detector,
)
from veilframe.functions.matching import has_match, matches

KEYWORDS = [k.replace("_?", "_") for k in CREDENTIAL_KEYWORDS] + ["apikey"]
# What each property asks for: (kind, what holds a match, what does not).
PROPERTIES = [
    # Absolute paths anywhere, whatever ends them; no relative ones.
    (FILE_DIR, ["/srv", "/srv/", "open /opt/x_1/y-2.tar.gz now", "\t/v1.2//lib", "(/q)"], ["", "srv", "srv/www", "x/y.z", "1/2"]),
    # A keyword in any case, one separator with or without blanks, a value.
    (
        CREDENTIALS,
        [f"{word}{separator}Zx9" for word in KEYWORDS for separator in (":", "=", " ", " : ", "= ", "\t=", "  ")]
        + ["PassWord: q", "now user=eve, then", "a token b"],
        ["usernames are", "user-eve", "mypassword=1", "secret", "pwd:", "token\nvalue", "api key"],
    ),
    # Four octets of at most 255, not inside a longer word or number.
    (
        IPV4,
        ["8.8.4.4", "at 192.168.0.255:443", "0.0.0.0/0", "(172.31.9.1)", "009.1.1.1", "1.2.3.4.5"],
        ["256.1.1.1", "1.2.3", "1.2.3.", "v8.8.4.4x", "1,2,3,4", "8.8.4.444", "a1.2.3.4b"],
    ),
    (MAC_ADDR, ["de:ad:BE:ef:00:01", "(01:23:45:67:89:ab)"], ["de:ad:be:ef:00", "xde:ad:be:ef:00:01", "de-ad-be-ef-00-01"]),
    # Bounded on the left; a leading "::" alone is too little.
    (
        IPV6,
        ["2001:db8::ff00:42:8329", "via fe80::1", "fe80:%en0", "9:8:7:6:5:4:3:2", "64::", "1::8.8.4.4"],
        ["::1", "::", "std::vector", "ns::std", "9:8:7:6:5:4:3", "23:59:59", "xyz::1"],
    ),
]
CASES = [(kind, t, e) for kind, yes, no in PROPERTIES for e, texts in ((True, yes), (False, no)) for t in texts]


def test_strict_cases_in_spark(spark):
    df = spark.createDataFrame(CASES, "kind string, text string, expect boolean")
    for d in strict_profile():
        wrong = df.where((F.col("kind") == d.kind) & (has_match(F.col("text"), d) != F.col("expect")))
        assert wrong.collect() == [], d.kind


@pytest.mark.parametrize(
    "pattern",
    [r"a\s+b", r"a[^b]c", r"(?s)a.b", r"a\Wb", r"a\Db", r"a\nb", "a\nb", r"[\s]", r"(?is:x)", r"a\x0ab", r"\R", r"\P{L}", r"[\D]"],
)
def test_patterns_that_may_cross_lines_are_refused(pattern):
    with pytest.raises(ValueError, match="newline"):
        Detector("X", pattern)


@pytest.mark.parametrize("pattern", [r"a[ \t]b", r"a.b", r"[^\n]x", r"[^\sx]y", r"\w+\d\S\b", r"(?i)x", r"[a\]b]", r"a\\b"])
def test_patterns_within_lines_are_accepted(pattern):
    assert Detector("X", pattern).regex == pattern


def test_keyword_stems():
    assert keyword_stems(["user", "username", "Pass(?:word)?", "api_?key", "keys?"]) == ("api", "key", "pass", "user")
    assert keyword_stems(["a|b", "x"]) == keyword_stems([".x"]) == keyword_stems(["?"]) == ()


def test_strict_cases_in_duckdb():
    con = duckdb.connect()
    regex = {d.kind: d.regex for d in strict_profile()}
    for kind, text, expect in CASES:
        got = con.execute("SELECT regexp_matches(?, ?)", [text, regex[kind]]).fetchone()[0]
        assert got == expect, (kind, text)


@pytest.mark.parametrize(
    "kind, text, expected",
    [
        (IPV4, "502.141.30.40", ["02.141.30.40"]),
        (IPV4, "1.2.3.4port", ["1.2.3.4"]),
        (IPV6, "std::vector", ["d::"]),
        (IPV6, "fe80::20d:3aff:fe0f:b1bb", ["fe80::"]),
        (MAC_ADDR, "x02:00:11:aa:BB:0c0", ["02:00:11:aa:BB:0c"]),
        (CREDENTIALS, "user bob, pwd=x;y", ["user bob", "pwd=x"]),
        (FILE_DIR, "see /a//b, https://h/p", ["/a//b", "/h/p"]),
    ],
)
def test_loose_matches(spark, kind, text, expected):
    (d,) = pick(loose_profile(), kind)
    found = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), d)).first()[0]
    assert found == expected


def test_no_match_crosses_a_newline(spark):
    text = "password:\nabc /a\n/b 1.2.3\n.4 user=\nx"
    df = spark.createDataFrame([(text,)], "t string")
    for d in strict_profile() + loose_profile():
        by_cell = df.select(F.explode(matches(F.col("t"), d))).collect()
        by_line = df.select(F.explode(F.split("t", "\n")).alias("t")).select(
            F.explode(matches(F.col("t"), d))
        )
        assert by_cell == by_line.collect(), d.kind


def test_very_long_segments_do_not_overflow_the_stack(spark):
    df = spark.range(1).select(
        F.expr("repeat('/ab', 200000)").alias("path"),
        F.expr("concat('user', repeat(' ', 200000), ',')").alias("blanks"),
        F.expr("concat('user=', repeat('x', 200000))").alias("value"),
    )
    path, credentials = pick(strict_profile(), FILE_DIR, CREDENTIALS)
    row = df.select(
        matches(F.col("path"), path).alias("path"),
        matches(F.col("blanks"), credentials).alias("blanks"),
        matches(F.col("value"), credentials).alias("value"),
    ).first()
    assert [len(m) for m in row["path"]] == [600000]
    assert row["blanks"] == []
    assert [len(m) for m in row["value"]] == [200005]


def test_keywords_are_a_parameter(spark):
    (d,) = pick(strict_profile(["geheim"]), CREDENTIALS)
    df = spark.createDataFrame([("geheim: x", True), ("password: x", False)], "t string, e boolean")
    assert df.where(has_match(F.col("t"), d) != F.col("e")).count() == 0
    with pytest.raises(ValueError):
        credentials_pattern([])


def test_detector_validation():
    with pytest.raises(ValueError):
        Detector("lower", "x")
    with pytest.raises(ValueError):
        Detector("X", "")
    with pytest.raises(ValueError):
        with_detector(strict_profile(), Detector(IPV4, "x"))
    with pytest.raises(ValueError):
        pick(strict_profile(), "NO-SUCH")

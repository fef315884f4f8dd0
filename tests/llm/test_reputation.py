"""Host reputation: parsing, rules, shrinking; the SQL is checked in the catalogue run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilframe.llm import reputation

SCHEMA = "page_id bigint, url string, out int, host string, path string, bad string, n int"


def judged(spark, rows, **options):
    df = spark.createDataFrame([(*r, "h", "p", "b", 1) for r in rows], SCHEMA)
    return sorted(reputation.judge(df, F.col("out"), **options).collect(), key=repr)


def test_parts_and_rules(spark):
    cases = [
        ("https://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://example.net?q=/en/", "example.net", "", None, "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://www.example.com/de/#f", "www.example.com", "/de/", "example.com/de/", "block"),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("x://net/", "net", "/", "net/", "block"),
        ("x://y.net/en", "y.net", "/en", "net/", "block"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("É://ÉA\n/x\ny?z", "Éa\n", "/x\ny", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    rows = [(n, c[0], None) for n, c in enumerate(cases)] + [(None, None, None)]
    got = judged(spark, rows)
    want = [(n, *c[1:]) for n, c in enumerate(cases)] + [(None, "", "", None, "allow")]
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: repr(spark.createDataFrame([w], "page_id bigint, host string, path string, rule string, verdict string").first()))


def test_suffixes(spark):
    hosts = ["a.b.example.com", "x.co.uk", "w.x.co.uk", "com", "", "u@h.example.org:80"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select(*reputation.suffix_and_domain(F.col("host")))
    assert [tuple(r) for r in df.collect()] == [
        ("com", "example.com"), ("co.uk", "x.co.uk"), ("co.uk", "x.co.uk"), ("com", "com"), ("", ""), ("org", "example.org"),
    ]


def test_few_outcomes_block_nothing_many_do(spark):
    rows = [(n, f"x://good{n % 9}.a.com/", int(n % 50 == 0)) for n in range(900)]
    rows += [(1000 + n, "x://bad.a.com/", int(n % 10 != 0)) for n in range(100)]
    rows += [(2000, "x://new.a.com/", 1), (2001, "x://new.a.com/", None)]
    verdict = {r.host: r.verdict for r in judged(spark, rows, rules=())}
    assert verdict["bad.a.com"] == "block"
    assert {v for h, v in verdict.items() if h != "bad.a.com"} == {"allow"}
    same = judged(spark, rows, rules=(), settings=reputation.Settings(broadcast_limit=0))
    assert {r.host: r.verdict for r in same} == verdict


def test_unseen_hosts_follow_their_domain(spark):
    rows = [(n, f"x://h{n % 40}.spam.com/", 1) for n in range(800)] + [(5000 + n, f"x://h{n % 40}.fine.com/", 0) for n in range(800)]
    rows += [(9000, "x://other.spam.com/", None), (9001, "x://other.fine.com/", None)]
    verdict = {r.host: r.verdict for r in judged(spark, rows, rules=())}
    assert (verdict["other.spam.com"], verdict["other.fine.com"]) == ("block", "allow")


def test_empty_table(spark):
    assert judged(spark, []) == []


@pytest.mark.parametrize("level", ["top"])
def test_strength_by_moments(spark, level):
    children = [("", n, k) for n, k in ((10, 1), (20, 8), (30, 3), (40, 30))]
    df = spark.createDataFrame(children, "top string, n long, k long")
    parents = df.groupBy("top").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    m, total = 42.5 / 101, 100
    x = sum(n * (k / n - m) ** 2 / (m * (1 - m)) for _, n, k in children)
    extra = sum(n - n * n / total for _, n, _ in children)
    rho = (x - 3) / (extra - 3)
    assert reputation._strength(df, parents, level, reputation.Settings()) == pytest.approx(1 / rho - 1)

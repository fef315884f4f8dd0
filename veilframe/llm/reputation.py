"""URL filter by empirical-Bayes reputation of hosts.

The share of bad pages is estimated for suffixes, registered domains and hosts.
Each estimate is drawn towards that of its parent by a beta-binomial prior whose
strength comes from how much siblings differ; a host is blocked if even a low
bound of its posterior is above the limit, so that few outcomes block nothing.
Explicit rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.joins import attach
from veilframe.shared import written

# Registry suffixes of two labels.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Settings:
    """Block if ``mean - z * deviation`` of the posterior is above ``limit``."""

    limit: float = 0.5
    z: float = 1.645
    broadcast_limit: int = 8 << 20
    weakest: float = 0.001
    strongest: float = 0.999


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; path from there up to ``?``, ``#`` or the end."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), whole, 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(F.coalesce(url, F.lit("")), whole, 2)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Registry suffix and registered domain of a host, user and port left out."""
    labels = F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    long = last(2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, last(2)).otherwise(last(1)), F.when(long, last(3)).otherwise(last(2))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(decision))
    empty = F.lit(None).cast("string")
    return (empty, empty) if not rules else (rule, verdict)


def _strength(children: DataFrame, parents: DataFrame, on: str, s: Settings) -> float:
    """Pseudo-counts of the beta prior that children of one parent share, by
    moments: the less siblings differ beyond chance, the more."""
    mean = (F.col("_k") + 0.5) / (F.col("_n") + 1.0)
    parent = parents.select(F.col(on).alias("_on"), F.col("n").alias("_n"), F.col("k").alias("_k"))
    seen = children.where("n > 0").join(parent, F.col(on) == F.col("_on"))
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2) / (mean * (1 - mean))
    x, extra, free = seen.agg(
        F.sum(spread), F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("_n")), F.count("*")
    ).first()
    groups = seen.select("_on").distinct().count()
    free -= groups
    if not free or extra <= free:
        return 1 / s.weakest - 1
    correlation = min(max((x - free) / (extra - free), s.weakest), s.strongest)
    return 1 / correlation - 1


def reputations(pages: DataFrame, s: Settings) -> DataFrame:
    """``(host, blocked)`` from ``pages`` with ``host`` and ``bad`` (0, 1, or
    null if unknown)."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(hosts.withColumn("suffix", suffix).withColumn("domain", domain).withColumn("top", F.lit("")), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = written(hosts.groupBy("domain", "suffix", "top").agg(*sums), "domains")
    suffixes = written(domains.groupBy("suffix", "top").agg(*sums), "suffixes")
    top = suffixes.groupBy("top").agg(*sums)

    def shrunk(children: DataFrame, parents: DataFrame, parent_mean: DataFrame, on: str) -> DataFrame:
        strength = F.lit(_strength(children, parents, on, s))
        prior = parent_mean.select(F.col(on).alias("_on"), F.col("mean").alias("_mean"))
        a = strength * F.col("_mean") + F.col("k")
        total = strength + F.col("n")
        near = children.join(prior, F.col(on) == F.col("_on"))
        return near.withColumn("total", total).withColumn("mean", a / total).drop("_on", "_mean")

    top_mean = top.withColumn("mean", (F.col("k") + 1.0) / (F.col("n") + 2.0))
    suffix_mean = shrunk(suffixes, top, top_mean, "top")
    domain_mean = shrunk(domains, suffixes, suffix_mean, "suffix")
    host_mean = shrunk(hosts, domains, domain_mean.drop("suffix"), "domain")
    m = F.col("mean")
    bound = m - s.z * F.sqrt(m * (1 - m) / (F.col("total") + 1))
    return host_mean.select("host", (bound > s.limit).alias("blocked"))


def judge(
    pages: DataFrame, outcome: Column, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, settings: Settings | None = None,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``outcome`` is 1 for a bad page, 0 for a good one, null if not known.  A
    null url, or one without ``://``, has an empty host and path and is judged
    by the pages like it; rows with equal ids or urls are all judged; without
    outcomes the method allows everything.
    """
    s = settings or Settings()
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), outcome.cast("long").alias("bad"))
    parts = written(parts, "urls")
    known = written(reputations(parts.select("host", "bad"), s), "reputations")
    judged = attach(parts, known, ["host"], broadcast_limit=s.broadcast_limit)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict")
    )

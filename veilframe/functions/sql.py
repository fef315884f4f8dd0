"""Tokens and scrubbing as named SQL functions.

They are SQL functions, not UDFs: Catalyst inlines their bodies.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from veilframe.detectors import Detector, in_order
from veilframe.functions.tokens import TokenRule, alphabet_sql, seal_sql, unseal_sql


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(
    spark: SparkSession, detectors: list[Detector], tokens: TokenRule, prefix: str = "veil"
) -> list[str]:
    """Create ``<prefix>_token(kind, segment)``, ``<prefix>_scrub(text)`` and one
    ``<prefix>_scrub_<kind>(text)`` per detector; returns their names."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", prefix):
        raise ValueError(f"prefix must be a plain name: {prefix!r}")
    token = f"{prefix}_token"
    body = "concat('{{', kind, '-', " + tokens.body_sql("lower(kind)", "segment") + ", '}}')"
    _create(spark, token, "kind STRING, segment STRING", body)
    created = [token]
    for d in in_order(detectors):
        name = f"{prefix}_scrub_{d.kind.lower().replace('-', '_')}"
        _create(spark, name, "text STRING", _scrubbed([d], tokens))
        created.append(name)
    _create(spark, f"{prefix}_scrub", "text STRING", _scrubbed(in_order(detectors), tokens))
    return [*created, f"{prefix}_scrub"]


def _scrubbed(detectors: list[Detector], tokens: TokenRule) -> str:
    """The text rewritten kind after kind; finished tokens are sealed against
    later kinds, as in tokenised()."""
    now = "text"
    for d in detectors:
        now = _step(now, d, tokens)
    return f"element_at(transform(array({alphabet_sql('text')}), abc -> {unseal_sql(now, 'abc')}), 1)"


def _step(text: str, d: Detector, tokens: TokenRule) -> str:
    """The text with the matches of one kind replaced, bound once by transform
    so that nested steps do not multiply."""
    rewritten = f"CASE WHEN {_found('t', d)} THEN {_glued('t', d, tokens)} ELSE t END"
    return f"element_at(transform(array({text}), t -> {rewritten}), 1)"


def _found(text: str, d: Detector) -> str:
    """Does the detector find something, cheap checks first?"""
    signs = [f"contains({text}, {_literal(d.sign)})"] if d.sign else []
    signs += [f"{text} RLIKE {_literal(d.precheck)}"] if d.precheck else []
    checks = [f"contains({text}, {_literal(d.needs)})"] if d.needs else []
    if d.any_of:
        checks.append("(" + " OR ".join(f"contains(lower({text}), {_literal(w)})" for w in d.any_of) + ")")
    checks += [f"({' OR '.join(signs)})"] if signs else []
    return " AND ".join([*checks, f"{text} RLIKE {_literal(d.sealed_regex)}"])


def _glued(text: str, d: Detector, tokens: TokenRule) -> str:
    """The text between matches, joined by the tokens of the matches."""
    pattern = _literal(d.sealed_regex)
    body = tokens.body_sql(_literal(d.kind.lower()), unseal_sql("hit", "abc") if d.takes_tokens else "hit")
    token = f"concat({_literal('{{' + d.kind + '-')}, {body}, '}}}}')"
    return (
        f"array_join(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
        f"(gap, hit) -> concat(gap, coalesce({seal_sql(token, 'abc')}, ''))), '')"
    )


def _create(spark: SparkSession, name: str, params: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS STRING RETURN {body}")

"""Plain Python versions of the rewrites, line by line, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from veilframe.detectors import Detector, in_order


def token(kind: str, text: str, salt: str = "1234", width: int = 5) -> str:
    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    return "{{" + kind + "-" + md5(md5(kind.lower() + salt)[:5] + text)[:width] + "}}"


def matches(detector: Detector, text: str) -> list[str]:
    return [m.group(0) for m in re.finditer(detector.regex, text, re.ASCII)]


def scrub(text: str, detectors: list[Detector], new=None) -> str:
    """Kind after kind over what is no token yet; a value of CREDENTIALS runs to
    the next blank and may take tokens in.  ``new`` gives a match's replacement."""
    new = new or token
    pieces = [(False, text)]
    for d in in_order(detectors):
        if d.kind == "CREDENTIALS":
            whole, starts = "".join(p for _, p in pieces), {}
            at = 0
            for done, piece in pieces:
                if done:
                    starts[at] = at + len(piece)
                at += len(piece)
            pieces = _around(whole, [(*m.span(), new(d.kind, m.group(0))) for m in re.finditer(d.regex, whole, re.ASCII)], starts)
            continue
        cut = []
        for done, piece in pieces:
            found = [] if done else [(*m.span(), new(d.kind, m.group(0))) for m in re.finditer(d.regex, piece, re.ASCII)]
            cut += [(True, piece)] if done else _around(piece, found, {})
        pieces = cut
    return "".join(p for _, p in pieces)


def _around(text: str, found, done: dict[int, int]):
    """The text in pieces: replaced matches, finished tokens (``done``, those
    within a match are gone), and what is between."""
    spans = [(a, b, t) for a, b, t in found]
    spans += [(a, b, text[a:b]) for a, b in done.items() if not any(x < b and a < y for x, y, _ in found)]
    pieces, at = [], 0
    for a, b, replaced in sorted(spans):
        pieces += [(False, text[at:a]), (True, replaced)]
        at = b
    return [*pieces, (False, text[at:])]


def segments(rows, detectors: list[Detector]):
    """``{file: {(kind, segment)}}`` of ``(file, line)`` rows, empty files too."""
    found = defaultdict(set)
    for file, line in rows:
        found[file]
        for d in detectors:
            found[file] |= {(d.kind, s) for s in matches(d, line or "")}
    return found


def clean(segment: str) -> str:
    return segment.rstrip("'").strip(" \t\r\n\f\x0b")


def dictionary_rewrite(rows, detectors: list[Detector]):
    """The rewritten lines of ``(file, line)`` rows, in input order."""
    priority = {d.kind: d.priority for d in detectors}
    dictionaries = {}
    for file, found in segments(rows, detectors).items():
        cleaned = {(k, clean(s)) for k, s in found} - {(k, "") for k in priority}
        dictionaries[file] = sorted(cleaned, key=lambda e: (priority[e[0]], -len(e[1]), e[1]))
    out = []
    for file, line in rows:
        text = line
        for kind, segment in dictionaries[file]:
            if line is not None and segment in line:
                text = text.replace(segment, token(kind, segment))
        out.append(text)
    return out

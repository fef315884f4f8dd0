"""What counts as sensitive: one ``Detector`` per kind, two profiles.

All patterns stay inside the syntax shared by Java's regex and RE2 (no
lookaround, no possessive quantifiers) and never match across a newline, so a
multi-line cell gives the same matches as its lines taken one by one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

# The kind labels as they appear in tokens.
FILE_DIR = "FILE-DIR"
CREDENTIALS = "CREDENTIALS"
MAC_ADDR = "MAC-ADDR"
IPV4 = "IPV4"
IPV6 = "IPV6"
KINDS = (FILE_DIR, CREDENTIALS, MAC_ADDR, IPV4, IPV6)

# The loose address patterns, unbounded on both sides.
LOOSE_IPV4 = r"(25[0-5]|2[0-4][0-9]|[0-1]?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|[0-1]?[0-9]?[0-9])){3}"
_IPV6_FORMS = (
    r"([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}",
    r"([0-9a-fA-F]{1,4}:){1,7}:",
    r"([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}",
    r"([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}",
    r"([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}",
    r"([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}",
    r"([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}",
    r"[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})",
    r":((:[0-9a-fA-F]{1,4}){1,7}|:)",
    r"fe80:(:[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}",
    r"::(ffff(:0{1,4}){0,1}:){0,1}((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}"
    r"(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])",
    r"([0-9a-fA-F]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}"
    r"(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])",
)
LOOSE_IPV6 = "(" + "|".join(_IPV6_FORMS) + ")"
LOOSE_MAC = r"([a-f0-9A-F]{2}:){5}[a-f0-9A-F]{2}"

# Our own strict patterns.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
STRICT_IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
STRICT_MAC = r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"
# Bounded on the left, so that no word loses its tail, and without the forms
# that start with a colon: "::1" stays, and so does "std::vector".
STRICT_IPV6 = r"(?i)\b(?:" + "|".join(f for f in _IPV6_FORMS if not f.startswith(":")) + ")"
# One flat character class instead of a repeated "/name" group: Java's matcher
# recurses once per group repetition, so a path of a few thousand components
# would overflow the task's stack.
ABSOLUTE_PATH = r"\B/[\w.\-][\w.\-/]*"

CREDENTIAL_KEYWORDS = (
    "username",
    "user",
    "password",
    "passwd",
    "pwd",
    "passphrase",
    "secret",
    "token",
    "api_?key",
)


def credentials_pattern(keywords: Sequence[str] = CREDENTIAL_KEYWORDS) -> str:
    """``keyword``, then ``:`` / ``=`` / blanks, then a value up to blank, ``,`` or ``;``."""
    if not keywords:
        raise ValueError("at least one credential keyword is needed")
    return rf"(?i)\b(?:{'|'.join(keywords)})(?:[ \t]*[:=][ \t]*|[ \t]+)[^ \t\r\n\f\x0b,;]+"


# A class with its content, or any other escape, or a flag group.
_PARTS = re.compile(r"\[(\^?)((?:\\.|[^\]\\])+)\]|\\(x\{?[0-9a-fA-F]+\}?|u[0-9a-fA-F]{4}|0[0-7]+|.)|\(\?([a-z]+)[:)]", re.S)
_NEWLINES = re.compile(r"\\(?:[sWDnRvXPpHN]|x0[aA]|x\{0*[aA]\}|u000[aA]|0?12)|\n")
_NAMED_NEWLINE = re.compile(r"\\(?:[nsv]|x0[aA]|x\{0*[aA]\}|u000[aA])|\n")


def may_cross_lines(regex: str) -> bool:
    """Could the pattern match a newline?  Yes when in doubt: a negated class
    has to name the newline, and ``.`` must not be told to match it."""
    for part in _PARTS.finditer(regex):
        negated, content, _, flags = part.groups()
        if content is not None:
            if not _NAMED_NEWLINE.search(content) if negated else _NEWLINES.search(content):
                return True
        elif flags is not None:
            if "s" in flags:
                return True
        elif _NEWLINES.match(part.group()):
            return True
    return "\n" in _PARTS.sub("", regex)


# Characters that finished tokens are written in while other kinds are sought.
PRIVATE = "\ue000-\uf8ff"
_OUTSIDE = f"&&[^{PRIVATE}]]"
_PIECE = re.compile(r"\\Q.*?(?:\\E|$)|\\[pP]\{[^}]*\}|\\.|\(\?<?[=!:a-zA-Z>-]*|.", re.S)
# Escapes of single characters that stand for no private one.
_PLAIN_ESCAPES = set("dwshvtnrfae0123456789xubBAGzZkcQ") | set("\\.[]{}()*+?^$|-/&~#<>=!:,;'\"@%_ `")


def _class_end(regex: str, start: int) -> int:
    """Behind the class that opens at ``start``."""
    depth, at = 0, start
    while at < len(regex):
        if regex[at] == "\\":
            at += 1
        elif regex[at] == "[":
            depth += 1
        elif regex[at] == "]" and regex[at - 1 : at + 1] not in ("[]",) and regex[at - 2 : at + 1] != "[^]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    raise ValueError(f"class without an end: {regex!r}")


def without_private(regex: str) -> str:
    """The pattern with every class, ``.`` and class escape kept from matching
    private characters; a pattern of plain characters comes back as it is."""
    parts, at = [], 0
    while at < len(regex):
        if regex[at] == "[":
            end = _class_end(regex, at)
            content = regex[at:end]
            wide = "[^" in content or not content.isascii() or any(e not in _PLAIN_ESCAPES for e in re.findall(r"\\(.)", content, re.S))
            parts.append(f"[{content}{_OUTSIDE}" if wide else content)
            at = end
            continue
        piece = _PIECE.match(regex, at).group()
        at += len(piece)
        if piece == ".":
            parts.append(f"[^\\n\\r\\u0085\\u2028\\u2029{PRIVATE}]")
        elif len(piece) > 1 and piece[0] == "\\" and piece[1] not in _PLAIN_ESCAPES:
            parts.append(f"[{piece}{_OUTSIDE}")
        else:
            parts.append(piece)
    return "".join(parts)


# Letters, digits, signs below the braces, word bounds, classes of such, groups,
# and repeats of one or more.
_BRACELESS = re.compile(r"(?:[\w \-/:,;=@#%&<>!]|\\[bBdw.\-/+*?()\[\]|^$\\]|\[[\w ./:,;=@#%\-]+\]|\((?:\?:)?(?!\||\))|\)|\|(?![|)])|\+|\{[1-9][0-9]*(?:,[0-9]*)?\})+", re.ASCII)


def is_braceless(regex: str) -> bool:
    """Does the pattern show that no match is empty, holds a brace or depends on
    one next to it?  No when in doubt."""
    bare_bound = re.search(r"(?:^|[|(:])(?:\\[bB])+(?:$|[|)+{])", regex)
    return bool(_BRACELESS.fullmatch(regex)) and regex[0] != "|" and regex[-1] != "|" and not bare_bound


@dataclass(frozen=True)
class Detector:
    """A kind of sensitive segment.

    ``phase`` and ``rank`` give the rewriting order.  A text that holds a match
    holds the literal ``needs``, one of the lower-case literals ``any_of`` in
    some case, and besides the literal ``sign`` or a match of the cheap pattern
    ``precheck``; whichever are given let a row skip the full pattern and never
    change a result.  ``ahead`` is a cheap pattern that holds at the start of
    every match; looked at first, it spares most places of a text the full
    pattern.  A pattern that may match a newline is refused: texts are
    cut into lines; so is one that names private-use characters, which no kind
    matches.  ``takes_tokens`` lets matches take in finished tokens of kinds
    that come before.  ``no_braces`` says that no match holds a brace.
    """

    kind: str
    regex: str
    phase: int = 1
    rank: int = 0
    needs: str | None = None
    sign: str | None = None
    precheck: str | None = None
    any_of: tuple[str, ...] = ()
    takes_tokens: bool = False
    no_braces: bool = False
    ahead: str | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Z0-9][A-Z0-9-]*", self.kind):
            raise ValueError(f"kind must be upper-case letters, digits and dashes: {self.kind!r}")
        if not self.regex:
            raise ValueError("a detector needs a pattern")
        if may_cross_lines(self.regex):
            raise ValueError(f"pattern may match a newline, write blanks as [ \\t]: {self.regex!r}")

        if re.search(f"[{PRIVATE}]", self.regex):
            raise ValueError(f"pattern names private-use characters: {self.regex!r}")

    @property
    def sought_regex(self) -> str:
        """The pattern as Spark seeks it; RE2, which has no lookahead, finds the
        same with ``regex``."""
        return f"(?={self.ahead}){self.regex}" if self.ahead else self.regex

    @property
    def sealed_regex(self) -> str:
        """The pattern as it is used on texts that hold finished tokens."""
        return self.sought_regex if self.takes_tokens else without_private(self.sought_regex)

    @property
    def priority(self) -> int:
        """Position in the overall order: earlier phases first."""
        return self.phase * 100 + self.rank


# An IPv6 address holds "::", or eight groups, or a zone right after "fe80:".
_GROUP = "[0-9a-fA-F]{1,4}+:"
_V6_PRECHECK = f":(?:%|{_GROUP * 6}[0-9a-fA-F])"
_V4_PRECHECK = r"[0-9]\.[0-9]"
# How the addresses start: seven characters at least; a group, if any, and its
# colon, then a zone, or up to six more groups before a second colon, or six
# more and an eighth, read in one go.
_V4_AHEAD = r"[0-9][0-9.]{6}"
_V6_AHEAD = f"[0-9a-fA-F]{{0,4}}+:(?:%|{f'(?::|{_GROUP}' * 6}[:0-9a-fA-F]{')' * 6})"


def _plain_starts(keywords: Sequence[str]) -> set[str]:
    """The plain start of each keyword, in lower case; none if one has none."""
    stems = set()
    for keyword in keywords:
        plain = re.match(r"[A-Za-z0-9_]*", keyword).group()
        following = keyword[len(plain) :]
        if following[:1] in ("?", "*", "{"):
            plain = plain[:-1]
        if not plain or "|" in following:
            return set()
        stems.add(plain.lower())
    return stems


def keyword_stems(keywords: Sequence[str]) -> tuple[str, ...]:
    """Literals one of which, in some case, occurs wherever a keyword matches;
    none if a keyword has no plain start."""
    stems = _plain_starts(keywords)
    return tuple(sorted(s for s in stems if not any(o != s and o in s for o in stems)))


def keyword_ahead(keywords: Sequence[str]) -> str | None:
    """The first characters of keywords, in any case, as a class."""
    first = sorted({c for s in _plain_starts(keywords) for c in (s[0], s[0].upper())})
    return f"[{''.join(first)}]" if first else None


def strict_profile(keywords: Sequence[str] = CREDENTIAL_KEYWORDS) -> list[Detector]:
    """Bounded patterns, used for in-line scrubbing, addresses before paths.

    So the ``/8`` of ``127.0.0.1/8``, which follows the token of an address by
    then, becomes a path token, as seen in already masked ``ip addr`` logs.
    """
    return [
        Detector(IPV4, STRICT_IPV4, 1, 0, needs=".", precheck=_V4_PRECHECK, no_braces=True, ahead=_V4_AHEAD),
        Detector(IPV6, STRICT_IPV6, 1, 1, needs=":", sign="::", precheck=_V6_PRECHECK, no_braces=True, ahead=_V6_AHEAD),
        Detector(FILE_DIR, ABSOLUTE_PATH, 2, 0, needs="/", no_braces=True),
        Detector(CREDENTIALS, credentials_pattern(keywords), 2, 1, any_of=keyword_stems(keywords), takes_tokens=True, ahead=keyword_ahead(keywords)),
        Detector(MAC_ADDR, STRICT_MAC, 2, 2, needs=":", no_braces=True),
    ]


def loose_profile(keywords: Sequence[str] = CREDENTIAL_KEYWORDS) -> list[Detector]:
    """Case-insensitive patterns without word bounds on addresses, used for
    the dictionary rewrite and the constant mask, paths before addresses."""
    return [
        Detector(FILE_DIR, ABSOLUTE_PATH, 1, 0, needs="/", no_braces=True),
        Detector(CREDENTIALS, credentials_pattern(keywords), 1, 1, any_of=keyword_stems(keywords), takes_tokens=True, ahead=keyword_ahead(keywords)),
        Detector(MAC_ADDR, "(?i)" + LOOSE_MAC, 1, 2, needs=":", no_braces=True),
        Detector(IPV4, "(?i)" + LOOSE_IPV4, 2, 0, needs=".", precheck=_V4_PRECHECK, no_braces=True, ahead=_V4_AHEAD),
        Detector(IPV6, "(?i)" + LOOSE_IPV6, 2, 1, needs=":", sign="::", precheck=_V6_PRECHECK, no_braces=True, ahead=_V6_AHEAD),
    ]


def _addresses_in(detectors: Sequence[Detector], first: bool) -> list[Detector]:
    phase = lambda d: 1 if (d.kind in (IPV4, IPV6)) == first else 2
    return in_order([replace(d, phase=phase(d)) for d in detectors])


def addresses_first(detectors: Sequence[Detector]) -> list[Detector]:
    """The same detectors, addresses in the first phase."""
    return _addresses_in(detectors, True)


def paths_first(detectors: Sequence[Detector]) -> list[Detector]:
    """The same detectors, addresses in the last phase: the ``/8`` of
    ``127.0.0.1/8`` follows a word character and is no path."""
    return _addresses_in(detectors, False)


def with_detector(detectors: Sequence[Detector], extra: Detector) -> list[Detector]:
    """A profile with one more kind; kinds are unique within a profile."""
    if any(d.kind == extra.kind for d in detectors):
        raise ValueError(f"kind already present: {extra.kind}")
    return [*detectors, extra]


def spares_tokens(detector: Detector, kinds: Sequence[str]) -> bool:
    """Is nothing found inside a readable token of one of the kinds?

    A token is letters, digits and dashes between braces.  A match without
    braces lies wholly inside or outside, and inside there is no ``needs``; a
    credential's keyword is none of its letters.
    """
    if detector.takes_tokens:
        inside = [k.lower() for k in kinds]
        return bool(detector.any_of) and all(re.search("[^0-9a-f-]", w) and not any(w in k for k in inside) for w in detector.any_of)
    return detector.no_braces and detector.needs is not None and detector.needs in "/.:"


def in_order(detectors: Sequence[Detector]) -> list[Detector]:
    """Detectors in rewriting order."""
    return sorted(detectors, key=lambda d: (d.priority, d.kind))


def pick(detectors: Sequence[Detector], *kinds: str) -> list[Detector]:
    """The detectors of the given kinds."""
    chosen = [d for d in detectors if d.kind in kinds]
    if len(chosen) != len(set(kinds)):
        raise ValueError(f"unknown kind among {kinds}")
    return chosen

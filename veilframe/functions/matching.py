"""Match, count and rewrite expressions for one detector."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.detectors import Detector, in_order, is_braceless, spares_tokens
from veilframe.functions.tokens import HIDDEN, MARK, TokenRule, alphabet, holds_usual, seal, unseal

# How tokens begin.
_OPEN = "{{"


def may_match(text: Column, detector: Detector) -> Column | None:
    """Cheap necessary condition of a match, or None when there is none.

    The literal test runs on the UTF-8 bytes; it saves decoding the row and,
    for IPv6, a pattern ten times dearer than the others.
    """
    signs = []
    if detector.sign:
        signs.append(F.contains(text, F.lit(detector.sign)))
    if detector.precheck:
        signs.append(text.rlike(detector.precheck))
    checks = [reduce(lambda a, b: a | b, signs)] if signs else []
    if detector.any_of and not detector.ahead:  # which is as cheap
        in_lower = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in detector.any_of])
        checks.insert(0, _let(F.lower(text), in_lower))
    if detector.needs:
        checks.insert(0, F.contains(text, F.lit(detector.needs)))
    return reduce(lambda a, b: a & b, checks) if checks else None


def has_match(text: Column, detector: Detector) -> Column:
    """True when the detector finds something in the text."""
    gate = may_match(text, detector)
    found = text.rlike(detector.sought_regex)
    return found if gate is None else gate & found


def has_any_match(text: Column, detectors: list[Detector]) -> Column:
    """True when any of the detectors finds something."""
    return reduce(lambda a, b: a | b, [has_match(text, d) for d in detectors])


def matches(text: Column, detector: Detector) -> Column:
    """All matched substrings, in text order."""
    found = F.regexp_extract_all(text, F.lit(detector.sought_regex), F.lit(0))
    gate = may_match(text, detector)
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value, with the value computed once.

    Chained rewrites refer to their input several times.  Bound this way, a
    chain stays as long as it has links when the optimizer inlines it, into a
    filter pushed below the projection for example; spelled out, it would
    double or treble with every link.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def with_alphabet(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a text and of the private characters its tokens may use."""
    return _let(alphabet(text), lambda chosen: body(text, chosen))


def _tokenised(text: Column, detector: Detector, regex: str, token: Callable[[Column], Column], chosen: Column) -> Column:
    """Matches are marked in one pass, the text is cut at the marks, and the
    marked head of each piece becomes a token."""
    head, tail = chosen["head"], chosen["tail"]

    def piece(p: Column) -> Column:
        part = lambda n: F.call_function("substring_index", p, tail, F.lit(n))
        return F.when(F.contains(p, tail), F.concat(token(part(1)), part(-1))).otherwise(p)

    def unmarked(marked: Column) -> Column:
        pieces = F.transform(F.split(marked, head, -1), piece)
        return F.when(F.contains(marked, head), F.array_join(pieces, "")).otherwise(marked)

    marks = F.concat(head, F.lit("$0"), tail)
    rewritten = _let(F.regexp_replace(text, F.lit(regex), marks), unmarked)
    gate = may_match(text, detector)
    return rewritten if gate is None else F.when(gate, rewritten).otherwise(text)


def _readable(text: Column, detector: Detector, regex: str, token: Callable[[Column], Column]) -> Column:
    """The same for a text without the usual mark, which then stands on both
    sides of a match: every other piece is one."""

    def unmarked(marked: Column) -> Column:
        piece = lambda p, n: F.when(n.bitwiseAND(F.lit(1)) == 1, token(p)).otherwise(p)
        pieces = F.transform(F.split(marked, MARK, -1), piece)
        return F.when(F.contains(marked, F.lit(MARK)), F.array_join(pieces, "")).otherwise(marked)

    rewritten = _let(F.regexp_replace(text, F.lit(regex), F.lit(f"{MARK}$0{MARK}")), unmarked)
    gate = may_match(text, detector)
    return rewritten if gate is None else F.when(gate, rewritten).otherwise(text)


def _outside_tokens(regex: str, longest: int) -> str:
    """A pattern without braces, where no brace pair that begins a token, of so
    many characters and a dash at most, leads up to the match."""
    return rf"(?={regex})(?<!\{{\{{[A-Za-z0-9-]{{0,{longest + 1}}})(?:{regex})"


def _beside_tokens(text: Column, done: str, rewrite: Callable[[Column], Column]) -> Column:
    """``rewrite`` of what lies between the finished tokens, which ``done``
    finds: a private character stands for each of them meanwhile."""

    def shown(hidden: Column, rewritten: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(done), F.lit(0))
        pieces = F.zip_with(F.split(rewritten, HIDDEN, -1), tokens, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        return F.when(rewritten == hidden, text).otherwise(F.array_join(pieces, ""))

    hidden = F.regexp_replace(text, F.lit(done), F.lit(HIDDEN))
    beside = _let(hidden, lambda h: _let(rewrite(h), lambda r: shown(h, r)))
    return F.when(F.contains(text, F.lit(_OPEN)), beside).otherwise(rewrite(text))


def _chained(
    text: Column,
    detectors: list[Detector],
    n_digits: int,
    sealed_step: Callable[[Column, Detector, Column], Column],
    step: Callable[[Column, Detector, str], Column],
) -> Column:
    """Kind after kind in rewriting order, each on the output of the one
    before, with finished replacements sealed against the later kinds.

    Only a kind that says so, CREDENTIALS with a value of anything up to a
    blank, takes in the token of an address or path.  A kind that finds nothing
    inside a token, which holds for those built in, needs no sealing, and tokens
    (that end in ``n_digits``) are known by their braces where the text has none
    such itself: the others then rewrite what lies beside them.  Only texts that
    hold such braces or the usual marks are sealed.
    """
    ordered = in_order(detectors)

    def sealed(now: Column, chosen: Column) -> Column:
        for d in ordered:
            now = _let(now, _bound(sealed_step, d, chosen))
        return unseal(now, chosen)

    whole = with_alphabet(text, sealed)
    kinds = [d.kind for d in ordered]
    spared = [spares_tokens(d, kinds) for d in ordered]
    if any(d.takes_tokens and not spares for d, spares in zip(ordered, spared, strict=True)):
        return whole
    plain = text
    for n, d in enumerate(ordered):
        if spared[n]:
            plain = _let(plain, _bound(step, d, d.sought_regex))
        elif n == 0:
            plain = _let(plain, _bound(step, d, d.sealed_regex))
        elif is_braceless(d.regex):
            plain = _let(plain, _bound(step, d, _outside_tokens(d.regex, max(map(len, kinds[:n])) + n_digits)))
        else:
            digits = f"-[0-9a-f]{{{n_digits}}}" if n_digits else ""
            done = rf"\{{\{{(?:{'|'.join(kinds[:n])}){digits}\}}\}}"
            plain = _let(plain, _bound(_beside_tokens, done, _bound(step, d, d.sealed_regex)))
    unusual = holds_usual(text) | F.contains(text, F.lit(MARK))
    if not all(spared[1:]):
        unusual = unusual | F.contains(text, F.lit(_OPEN))
    return F.when(unusual, whole).otherwise(plain)


def tokenised(text: Column, detectors: list[Detector], tokens: TokenRule) -> Column:
    """The text with every match replaced by its token (see ``_chained``)."""

    def sealed_step(now: Column, d: Detector, chosen: Column) -> Column:
        # A replaced token inside the match is hashed as a reader would see it.
        plain = (lambda match: unseal(match, chosen)) if d.takes_tokens else (lambda match: match)
        return _tokenised(now, d, d.sealed_regex, lambda match: seal(tokens.token(d.kind, plain(match)), chosen), chosen)

    def step(now: Column, d: Detector, regex: str) -> Column:
        return _readable(now, d, regex, lambda match: tokens.token(d.kind, match))

    return _chained(text, detectors, tokens.width, sealed_step, step)


def _masked(text: Column, detector: Detector, regex: str, label: Column) -> Column:
    masked = F.regexp_replace(text, F.lit(regex), label)
    gate = may_match(text, detector)
    return masked if gate is None else F.when(gate, masked).otherwise(text)


def masked(text: Column, detectors: list[Detector]) -> Column:
    """The text with every match replaced by ``{{KIND}}`` (see ``_chained``)."""
    label = lambda d: F.lit("{{" + d.kind + "}}")

    def sealed_step(now: Column, d: Detector, chosen: Column) -> Column:
        return _masked(now, d, d.sealed_regex, seal(label(d), chosen))

    def step(now: Column, d: Detector, regex: str) -> Column:
        return _masked(now, d, regex, label(d))

    return _chained(text, detectors, 0, sealed_step, step)


def _bound(rewrite: Callable[..., Column], *args) -> Callable[[Column], Column]:
    # Spark counts lambda parameters, defaults included: hence a closure.
    return lambda text: rewrite(text, *args)


_BLANKS = " \t\r\n\f\x0b"


def clean_segment(segment: Column) -> Column:
    """Trailing single quotes off, then surrounding whitespace off."""
    return F.btrim(F.rtrim(segment, F.lit("'")), F.lit(_BLANKS))

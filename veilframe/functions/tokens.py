"""Salted tokens: ``{{KIND-xxxxx}}``.

The token of a segment depends only on kind, salt and text, so equal segments
get equal tokens in every file and masked data can still be joined on.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.detectors import PRIVATE

_HEX_DIGITS = {"md5": 32, "sha256": 64}
# Fixed value: the compatible rule, which keeps as many digits of the inner
# (kind + salt) hash as of the token.
_COMPATIBLE = ("md5", 5)
_MAC_BLOCK = 64

# Finished tokens are written in private characters while other kinds are
# still sought, so that no pattern finds anything inside them.  There are 50
# blocks of such characters; a text uses one that it does not hold itself.
_PLAIN = "{}-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_FIRST, _BLOCK, _BLOCKS, _USUAL = 0xE000, 128, 50, 2
_NO_BLOCK = (_PLAIN, "\ufdd0", "\ufdd1")


def _block(n: int) -> tuple[str, str, str]:
    """Letters of a block, and two further characters that mark a match."""
    base = _FIRST + _BLOCK * n
    return "".join(chr(base + ord(c)) for c in _PLAIN), chr(base), chr(base + 1)


# How the usual block's characters begin in UTF-8; a search for two bytes is
# far cheaper than a pattern.
_SIGNS = sorted({chr(_FIRST + _BLOCK * _USUAL + n).encode()[:2] for n in range(_BLOCK)})


def _named(block: tuple[str, str, str]) -> Column:
    return F.struct(*(F.lit(text).alias(name) for text, name in zip(block, ("letters", "head", "tail"), strict=True)))


# For texts that do not hold them: a mark around matches, not a private
# character, as texts beyond Latin-1 are dearer; and one that stands for a token.
MARK = "\x1a"
HIDDEN = _block(_USUAL)[0][0]


def holds_usual(text: Column) -> Column:
    """Does the text hold a character of the usual block?"""
    return reduce(lambda a, b: a | b, [F.contains(text.cast("binary"), F.lit(sign)) for sign in _SIGNS])


def alphabet(text: Column) -> Column:
    """``(letters, head, tail)`` of a block whose characters the text does not
    hold.  For a text with characters of all blocks tokens stay readable."""
    held = holds_usual(text)
    own = F.regexp_extract_all(text, F.lit(f"[{PRIVATE}]"), F.lit(0))
    taken = F.transform(own, lambda c: F.floor((F.ascii(c) - _FIRST) / _BLOCK).cast("int"))
    free = F.get(F.array_except(F.sequence(F.lit(0), F.lit(_BLOCKS - 1)), taken), F.lit(0))
    blocks = F.array(*(_named(_block(n)) for n in range(_BLOCKS)))
    return F.when(held, F.coalesce(F.get(blocks, free), _named(_NO_BLOCK))).otherwise(_named(_block(_USUAL)))


def alphabet_sql(text: str) -> str:
    """:func:`alphabet` as SQL."""
    of = lambda b: f"named_struct('letters', '{b[0]}', 'head', '{b[1]}', 'tail', '{b[2]}')"
    held = " OR ".join(f"contains(CAST({text} AS BINARY), X'{sign.hex()}')" for sign in _SIGNS)
    taken = f"transform(regexp_extract_all({text}, '[{PRIVATE}]', 0), c -> CAST(floor((ascii(c) - {_FIRST}) / {_BLOCK}) AS INT))"
    free = f"get(array_except(sequence(0, {_BLOCKS - 1}), {taken}), 0)"
    blocks = ", ".join(of(_block(n)) for n in range(_BLOCKS))
    return f"CASE WHEN {held} THEN coalesce(get(array({blocks}), {free}), {of(_NO_BLOCK)}) ELSE {of(_block(_USUAL))} END"


def seal(text: Column, chosen: Column) -> Column:
    """A token in the private characters of an :func:`alphabet`."""
    return F.call_function("translate", text, F.lit(_PLAIN), chosen["letters"])


def unseal(text: Column, chosen: Column) -> Column:
    """All sealed tokens of a text, readable again."""
    return F.call_function("translate", text, chosen["letters"], F.lit(_PLAIN))


def seal_sql(text: str, chosen: str) -> str:
    return f"translate({text}, '{_PLAIN}', {chosen}.letters)"


def unseal_sql(text: str, chosen: str) -> str:
    return f"translate({text}, {chosen}.letters, '{_PLAIN}')"


def pads(key: bytes, digest: str) -> tuple[bytes, bytes]:
    """The two blocks that begin the inner and the outer hash of an HMAC."""
    key = (hashlib.new(digest, key).digest() if len(key) > _MAC_BLOCK else key).ljust(_MAC_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def _hex(data: Column, digest: str) -> Column:
    return F.md5(data) if digest == "md5" else F.sha2(data, 256)


def hmac_hex(key: bytes, message: Column, digest: str = "sha256") -> Column:
    """HMAC of a binary column, as hex digits; the pads are constants."""
    inner, outer = pads(key, digest)
    return _hex(F.concat(F.lit(outer), F.unhex(_hex(F.concat(F.lit(inner), message), digest))), digest)


@dataclass(frozen=True)
class TokenRule:
    """How segments become tokens.  Five MD5 digits are the compatible
    default, a hash of the salted kind and the segment; every other rule is an
    HMAC of both with the salt as key, so that wide tokens are as strong as it."""

    salt: str = "1234"
    width: int = 5
    digest: str = "md5"

    def __post_init__(self) -> None:
        if self.digest not in _HEX_DIGITS:
            raise ValueError(f"digest must be one of {sorted(_HEX_DIGITS)}")
        if not 1 <= self.width <= _HEX_DIGITS[self.digest]:
            raise ValueError(f"width must be between 1 and {_HEX_DIGITS[self.digest]}")

    @property
    def is_compatible(self) -> bool:
        return (self.digest, self.width) == _COMPATIBLE

    def inner(self, kind: str) -> str:
        """The salted prefix of a kind by the compatible rule; constant, so
        hashed once on the driver."""
        return hashlib.md5((kind.lower() + self.salt).encode()).hexdigest()[: self.width]

    def _mac(self, message: Column) -> Column:
        return hmac_hex(self.salt.encode(), message.cast("binary"), self.digest)

    def token(self, kind: str, segment: Column) -> Column:
        """Token of ``segment`` for a fixed kind."""
        if self.is_compatible:
            body = F.md5(F.concat(F.lit(self.inner(kind)), segment).cast("binary"))
        else:
            body = self._mac(F.concat(F.lit(f"{kind.lower()}:"), segment))
        return F.concat(F.lit("{{" + kind + "-"), F.substring(body, 1, self.width), F.lit("}}"))

    def token_by(self, kind: Column, segment: Column) -> Column:
        """Token where the kind is itself a column."""
        if self.is_compatible:
            inner = F.substring(F.md5(F.concat(F.lower(kind), F.lit(self.salt)).cast("binary")), 1, self.width)
            body = F.md5(F.concat(inner, segment).cast("binary"))
        else:
            body = self._mac(F.concat(F.lower(kind), F.lit(":"), segment))
        return F.concat(F.lit("{{"), kind, F.lit("-"), F.substring(body, 1, self.width), F.lit("}}"))

    def body_sql(self, kind: str, segment: str) -> str:
        """SQL for the digits of a token; ``kind`` is in lower case."""
        if self.is_compatible:
            salt = self.salt.replace("\\", "\\\\").replace("'", "\\'")
            return f"left(md5(concat(left(md5(concat({kind}, '{salt}')), {self.width}), {segment})), {self.width})"
        inner, outer = pads(self.salt.encode(), self.digest)
        hashed = (lambda x: f"md5({x})") if self.digest == "md5" else (lambda x: f"sha2({x}, 256)")
        first = hashed(f"concat(X'{inner.hex()}', CAST(concat({kind}, ':', {segment}) AS BINARY))")
        return f"left({hashed(f'concat(X{chr(39)}{outer.hex()}{chr(39)}, unhex({first}))')}, {self.width})"

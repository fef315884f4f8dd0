"""Run options and their validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from veilframe.detectors import Detector, loose_profile, strict_profile, with_detector
from veilframe.functions.tokens import TokenRule

# Strategy names, default first where it matters.
IN_PLACE = "IN_PLACE"
SAM = "SAM"
SIP = "SIP"
LOW_LEVEL = "LOW_LEVEL"
HYBRID = "HYBRID"
HYBRID_SPLIT = "HYBRID_SPLIT"
RIPGREP = "RIPGREP"
STRATEGIES = (IN_PLACE, SAM, SIP, LOW_LEVEL, HYBRID, HYBRID_SPLIT, RIPGREP)

# Defaults.
DEFAULT_SALT = "1234"
DEFAULT_THRESHOLD = 200
DEFAULT_MIN_SPLIT_BYTES = 5 * 1024 * 1024


@dataclass(frozen=True)
class Options:
    """Everything that changes the result of a run."""

    strategy: str = HYBRID
    salt: str = DEFAULT_SALT
    threshold: int = DEFAULT_THRESHOLD
    min_split_bytes: int = DEFAULT_MIN_SPLIT_BYTES
    num_parts: int = 8
    ignore_hint: str | None = None
    remove_original: bool = False
    token_width: int = 5
    digest: str = "md5"
    strict: list[Detector] = field(default_factory=strict_profile)
    loose: list[Detector] = field(default_factory=loose_profile)
    # Files with more dictionary entries than this take the substring join.
    max_inline_entries: int = 5_000
    # A joined side is broadcast only when its measured content is at most this.
    broadcast_limit_bytes: int = 32 * 1024 * 1024

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}, expected one of {STRATEGIES}")
        for name in ("threshold", "min_split_bytes", "num_parts", "max_inline_entries"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be an integer of at least 1, got {value!r}")
        if self.broadcast_limit_bytes < 0:
            raise ValueError("broadcast_limit_bytes must not be negative")
        if self.ignore_hint is not None:
            re.compile(self.ignore_hint)
        if {d.kind for d in self.strict} != {d.kind for d in self.loose}:
            # HYBRID finds files by one profile and may rewrite them by the other.
            raise ValueError("strict and loose profiles must have the same kinds, see with_kind")
        self.tokens  # validates digest and width

    def with_kind(self, extra: Detector) -> Options:
        """The options with one more kind in both profiles."""
        return replace(self, strict=with_detector(self.strict, extra), loose=with_detector(self.loose, extra))

    @property
    def tokens(self) -> TokenRule:
        return TokenRule(self.salt, self.token_width, self.digest)

"""Find sensitive segments in text tables and log folders and replace them
with salted, deterministic tokens, as plain Spark DataFrame jobs."""

from veilframe.detectors import Detector, loose_profile, strict_profile, with_detector
from veilframe.functions.tokens import TokenRule
from veilframe.options import STRATEGIES, Options
from veilframe.plans.strategies import pseudonymize

__all__ = [
    "Detector",
    "Options",
    "STRATEGIES",
    "TokenRule",
    "loose_profile",
    "pseudonymize",
    "strict_profile",
    "with_detector",
]

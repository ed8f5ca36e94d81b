"""Configuration of the parser."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

# Fixed values of the miner this engine agrees with.
DEFAULT_SYMBOLS = "()[]{}=,*"
RICH_SYMBOLS = string.punctuation
PLACEHOLDER = "<*>"
ALPHABETIC, NUMERIC, SYMBOLIC, WHITESPACE, IMPURE, SPECIAL_WHITE, SPECIAL_BLACK = range(7)


@dataclass(frozen=True)
class ParserConfig:
    """``threshold``: how often one token must come with another, of its own occurrences, to depend on it.
    ``pattern_sample``: the share of each cluster's messages that patterns are made from."""

    threshold: float = 0.5
    pattern_sample: float = 1.0
    symbols: str = DEFAULT_SYMBOLS
    special_whites: tuple[str, ...] = ()
    special_blacks: tuple[str, ...] = ()
    filter_alphabetic: bool = True
    filter_numeric: bool = False
    filter_impure: bool = False

    def __post_init__(self):
        if not (math.isfinite(self.threshold) and 0 <= self.threshold <= 1):
            raise ValueError("threshold must be a number from 0 to 1")
        if not (math.isfinite(self.pattern_sample) and 0 < self.pattern_sample <= 1):
            raise ValueError("pattern_sample must be a number above 0, up to 1")
        object.__setattr__(self, "special_whites", tuple(self.special_whites))
        object.__setattr__(self, "special_blacks", tuple(self.special_blacks))

    @property
    def kept_kinds(self) -> tuple[int, ...]:
        """Kinds of tokens that are counted and can be anchors."""
        chosen = ((ALPHABETIC, self.filter_alphabetic), (NUMERIC, self.filter_numeric), (IMPURE, self.filter_impure))
        return (*(k for k, on in chosen if on), SPECIAL_WHITE)

    @property
    def common_kinds(self) -> tuple[int, ...]:
        """Kinds of tokens that can be literal parts of a template."""
        return (*self.kept_kinds, SYMBOLIC, WHITESPACE)

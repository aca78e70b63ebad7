"""Column functions."""

from hushtext.functions.text import (
    fold_symbols,
    nfkc,
    normalize_text,
    squeeze_spaces,
    squeeze_punctuation,
    strip_space_before_punctuation,
    tidy_text,
    trim_whitespace,
)

__all__ = [
    "fold_symbols",
    "nfkc",
    "normalize_text",
    "squeeze_punctuation",
    "squeeze_spaces",
    "strip_space_before_punctuation",
    "tidy_text",
    "trim_whitespace",
]

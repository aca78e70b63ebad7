"""User options: extra words and the length range of a bare record number."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from hushtext.plans import fixed_values as fixed
from hushtext.plans.dictionary import LITERAL_CHARS, literal_or_table

FIELDS = ("names", "keywords", "mrn_min_length", "mrn_max_length")


@dataclass(frozen=True)
class Options:
    """Validated options.

    ``names`` and ``keywords`` may have any size and may also be one-column DataFrames.
    Up to ``literal_chars`` characters, defaults included, a dictionary becomes a pattern
    literal; beyond that it stays a table and is joined with the texts.
    """

    names: Iterable[str] | DataFrame = ()
    keywords: Iterable[str] | DataFrame = ()
    mrn_min_length: int | None = None
    mrn_max_length: int | None = None
    literal_chars: int = LITERAL_CHARS
    surnames: tuple[str, ...] | DataFrame = field(init=False, repr=False)
    facility_terms: tuple[str, ...] | DataFrame = field(init=False, repr=False)

    def __post_init__(self) -> None:
        low = self.mrn_min_length
        high = self.mrn_max_length
        low = fixed.MRN_MIN_LENGTH if low is None else low
        high = fixed.MRN_MAX_LENGTH if high is None else high
        if low <= 0 or high <= 0 or low > high:
            raise ValueError(f"invalid record number length range: {low}-{high}")
        set_ = object.__setattr__
        set_(self, "mrn_min_length", low)
        set_(self, "mrn_max_length", high)
        for name, defaults, extra in (
            ("surnames", fixed.SURNAMES, self.names),
            ("facility_terms", fixed.FACILITY_TERMS, self.keywords),
        ):
            set_(self, name, literal_or_table(defaults, extra, self.literal_chars))

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> Options:
        """Build from parsed JSON.  Unknown fields are ignored, wrong types raise."""
        known: dict[str, Any] = {}
        for name in ("names", "keywords"):
            if name in values:
                terms = values[name]
                if not isinstance(terms, list) or not all(
                    isinstance(t, str) for t in terms
                ):
                    raise ValueError(f"{name} must be a list of strings")
                known[name] = terms
        for name in ("mrn_min_length", "mrn_max_length"):
            number = values.get(name)
            if number is not None:
                if type(number) is not int or number < 0:
                    raise ValueError(f"{name} must be a non-negative whole number")
                known[name] = number
        return cls(**known)

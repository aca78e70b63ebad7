"""Rules for a matcher without backtracking, on ASCII texts.

Java tries a pattern again at every character; RE2, which comes with Arrow, reads a text
once.  It knows no lookaround and no possessive repetition, and those of the patterns
only save time: first characters are named ahead, and nothing is given back that the next
item could take.  So the same matches are found without them.  On ASCII texts the Unicode
classes shrink to a few ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

from hushtext.plans import fixed_values as fixed
from hushtext.plans.rules import ANY_CASE, EXACT, Rule

# a pattern longer than this, that of a long dictionary, may not fit RE2's memory
_MOST_CHARS = 20_000

# fixed values: the plain forms of patterns that look around to save time
_PLAIN = {
    fixed.EMAIL: r"\b[\w.+%-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    fixed.EMAIL_OBFUSCATED: (
        r"\b[\w.+-]+(?:\s+at\s+|\s*@\s*)[\w.-]+(?:\s+dot\s+[\w.-]+)+\b"
    ),
    fixed.PERSON_CAPITALS: (
        r"\b[A-Z][\p{L}’']+\s+[A-Z][\p{L}’']+(?:\s+[A-Z][\p{L}’']+)?\b"
    ),
}

# members of a class, for ASCII characters
_CLASSES = {"L": "A-Za-z", "IsAlphabetic": "A-Za-z", "M": "", "N": "0-9"}
_SPACE = r"\t-\r "


@dataclass(frozen=True)
class Step:
    """One rule: its pattern, its token, its counter, and whether stop terms are kept."""

    pattern: str
    token: str
    category: str
    keep_stop_terms: bool


def linear_steps(rules: list[Rule], stop_pattern: str) -> tuple[list[Step], str] | None:
    """The rules in this form with the pattern of stop terms, or None if one has none."""
    if any(rule.terms is not None for rule in rules):
        return None
    try:
        steps = [
            Step(linear_form(r.pattern), r.token, r.category, r.keep_stop_terms) for r in rules
        ]
        stop = linear_form(stop_pattern)
    except ValueError:
        return None
    if not all(_is_usable(p) for p in (stop, *(s.pattern for s in steps))):
        return None
    return steps, stop


@lru_cache(maxsize=256)
def _is_usable(pattern: str) -> bool:
    if len(pattern) > _MOST_CHARS:
        return False
    try:
        pc.match_substring_regex(pa.array(["a"]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def linear_form(pattern: str) -> str:
    """A pattern of ``rules`` for RE2, for ASCII texts; a ValueError if there is none."""
    flags = ANY_CASE if pattern.startswith(ANY_CASE) else EXACT
    if not pattern.startswith(flags):
        raise ValueError(pattern)
    body = pattern[len(flags) :]
    body = _PLAIN.get(body, body)
    found = ["(?i)" if flags == ANY_CASE else ""]
    at, in_class = 0, False
    while at < len(body):
        ch, escaped = body[at], body[at : at + 2]
        if ch == "\\":
            at += 2
            if escaped == r"\p":
                end = body.index("}", at)
                if not in_class:
                    raise ValueError(pattern)
                found.append(_CLASSES[body[at + 1 : end]])
                at = end + 1
            elif escaped in (r"\s", r"\S"):
                if in_class and escaped == r"\S":
                    raise ValueError(pattern)
                outside = "^" if escaped == r"\S" else ""
                found.append(_SPACE if in_class else f"[{outside}{_SPACE}]")
            elif escaped[1:].isalpha() and escaped[1] not in "bdwrn":
                raise ValueError(pattern)
            else:
                found.append(escaped)
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif body.startswith(("(?=[", r"(?=\d)"), at):
            # the first characters of what follows
            at = body.index("])" if body[at + 3] == "[" else ")", at)
            at = body.index(")", at) + 1
            continue
        elif ch in ".^$" or (body.startswith("(?", at) and body[at + 2] != ":"):
            raise ValueError(pattern)
        elif ch in "+*?}" and body[at + 1 : at + 2] == "+":
            at += 1
        found.append(ch)
        at += 1
    return "".join(found)

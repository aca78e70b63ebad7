"""Marks: single characters that stand for a match while a rule is applied.

A rule first puts marks where it matches; the number of marks is the count and
a plain replacement turns them into the token.  So the costly pattern runs once
per rule and not twice.  Marks are control characters that are no whitespace: one
byte each, so an ASCII text stays ASCII.  Should a text contain one all the same, ``protect`` spells it with an escape and ``unprotect`` brings
it back; to every rule the spelling is the same kind of character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = "\x01"
CLOSE = "\x02"
ESCAPE = "\x03"
WIDTH = len(OPEN.encode())

# the escape comes first here and last on the way back
_SPELLINGS = (
    (ESCAPE, ESCAPE + "\x04"),
    (OPEN, ESCAPE + "\x05"),
    (CLOSE, ESCAPE + "\x06"),
)


def has_mark(name: str) -> Column:
    return F.expr(f"contains({name}, '{OPEN}')")


def protect(name: str) -> Column:
    """The column with marks of its own spelled out."""
    spelled = F.col(name)
    for raw, spelling in _SPELLINGS:
        spelled = F.replace(spelled, F.lit(raw), F.lit(spelling))
    taken = " or ".join(f"contains({name}, '{raw}')" for raw, _ in _SPELLINGS)
    return F.when(F.expr(taken), spelled).otherwise(F.col(name))


def unprotect(name: str) -> Column:
    """The column with spelled-out marks brought back."""
    raw_text = F.col(name)
    for raw, spelling in reversed(_SPELLINGS):
        raw_text = F.replace(raw_text, F.lit(spelling), F.lit(raw))
    spelled = F.expr(f"contains({name}, '{ESCAPE}')")
    return F.when(spelled, raw_text).otherwise(F.col(name))


def protect_term(term: str) -> str:
    """The spelling of a dictionary term in a protected text."""
    for raw, spelling in _SPELLINGS:
        term = term.replace(raw, spelling)
    return term

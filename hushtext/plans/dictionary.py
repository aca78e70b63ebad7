"""Word lists: as one literal pattern each, or as tables.

A short dictionary lives on the driver and travels inside the plan as a pattern literal.
A long one stays a table on the cluster, see ``hushtext.operators.lookup``; its size is
measured there and decides.  The result is the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.operators.numbering import numbered
from hushtext.sources.scratch import written

# Unicode White_Space, as a strip set (str.strip() would also take U+001C-001F)
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters of a dictionary that still goes into a pattern literal, which is compiled
# once in every task.  A longer one stays on the cluster.
LITERAL_CHARS = 200_000


def build_dictionary(
    defaults: Iterable[str], extra: Iterable[str] | DataFrame = ()
) -> list[str] | DataFrame:
    """The defaults and the extra terms, distinct and in code point order.

    Extra terms are trimmed and blank ones dropped.  With a list the result is a list.
    With a one-column DataFrame it is one with the columns ``ord`` (from 1) and ``term``;
    it may have any size, as no step gathers all terms.
    """
    if isinstance(extra, DataFrame):
        return numbered(term_table(defaults, extra), "term")
    terms = set(defaults)
    terms.update(t.strip(WHITE_SPACE) for t in extra)
    terms.discard("")
    return sorted(terms)


def term_table(defaults: Iterable[str], extra: DataFrame) -> DataFrame:
    """The distinct terms, column ``term``, in no order."""
    if len(extra.columns) != 1:
        raise ValueError("a dictionary DataFrame must have exactly one column")
    trimmed = F.btrim(F.col(extra.columns[0]).cast("string"), F.lit(WHITE_SPACE))
    own = extra.sparkSession.createDataFrame([(t,) for t in defaults], "term string")
    return extra.select(trimmed.alias("term")).union(own).where("term <> ''").distinct()


def literal_or_table(
    defaults: Iterable[str], extra: Iterable[str] | DataFrame, literal_chars: int
) -> tuple[str, ...] | DataFrame:
    """The sorted terms if they have ``literal_chars`` characters at most, or their table."""
    if isinstance(extra, DataFrame):
        table = written(term_table(defaults, extra), "terms")
        if (table.agg(F.sum(F.length("term"))).first()[0] or 0) > literal_chars:
            return table
        return tuple(sorted(row.term for row in table.collect()))
    terms = build_dictionary(defaults, extra)
    if sum(map(len, terms)) <= literal_chars:
        return tuple(terms)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.createDataFrame([(t,) for t in terms], "term string")


def dictionary_pattern(terms: Iterable[str]) -> str | None:
    """Pattern body for "any of these terms, whole words", or None without terms.

    Terms are tried in the given order and the first one that fits wins.  An
    apostrophe in a term stands for the straight or the curly one; a space is
    exactly one space.
    """
    terms = list(terms)
    if not terms:
        return None
    # a class lookup spares most positions the word-boundary test
    lettered = all(term[0].isascii() and term[0].isalpha() for term in terms)
    ahead = "(?=[a-z])" if lettered else ""
    return rf"{ahead}\b{alternation(terms)}\b"


def alternation(terms: Iterable[str], whole_words: Iterable[str] = ()) -> str:
    """``(?:a|b|...)`` with shared beginnings factored out.

    The matcher tries branches one by one, so a flat list of n terms costs n
    attempts at every word; the factored form costs a few per letter.  A term
    only joins an earlier branch if no complete term stands between them, so the
    order of preference stays that of the list.  Each of ``whole_words`` must
    end at a word boundary as well.
    """
    root = _Branches()
    spelled = [[_atom(ch) for ch in term] for term in terms]
    spelled += [[*(_atom(ch) for ch in word), r"\b"] for word in whole_words]
    for atoms in spelled:
        node = root
        for atom in atoms:
            node = node.child(atom)
        node.end()
    return f"(?:{root.render()})"


# more branches than this are put behind lookaheads for groups of first letters
_FAN_OUT = 5


class _Branches:
    """Ordered choices after a common beginning; ``None`` ends a term."""

    def __init__(self) -> None:
        self.choices: list[tuple[str, _Branches] | None] = []
        self.joinable: dict[str, _Branches] = {}

    def child(self, atom: str) -> _Branches:
        if atom not in self.joinable:
            self.joinable[atom] = _Branches()
            self.choices.append((atom, self.joinable[atom]))
        return self.joinable[atom]

    def end(self) -> None:
        if None not in self.choices:
            self.choices.append(None)
            self.joinable = {}

    def render(self) -> str:
        parts = [self._render_choice(choice) for choice in self.choices]
        letters = [c[0] for c in self.choices if c is not None and c[0].isalpha()]
        if len(parts) <= _FAN_OUT or len(letters) < len(parts):
            return "|".join(parts)
        # plain letters exclude each other, so these may be regrouped freely
        return _fan_out(sorted(zip(letters, parts, strict=True)))

    def _render_choice(self, choice: tuple[str, _Branches] | None) -> str:
        text = ""
        while choice is not None:
            atom, node = choice
            text += atom
            if len(node.choices) > 1:
                return f"{text}(?:{node.render()})"
            choice = node.choices[0]
        return text


def _fan_out(parts: list[tuple[str, str]]) -> str:
    if len(parts) <= _FAN_OUT:
        return "|".join(part for _, part in parts)
    size = -(-len(parts) // _FAN_OUT)
    groups = [parts[i : i + size] for i in range(0, len(parts), size)]
    return "|".join(
        f"(?=[{''.join(letter for letter, _ in group)}])(?:{_fan_out(group)})"
        for group in groups
    )


def _atom(ch: str) -> str:
    """One character of a term as a pattern, for ASCII-only case folding."""
    if ch in "'’":
        return "[’']"
    if ch.isascii():
        return ch.lower() if ch.isalnum() or ch == " " else "\\" + ch
    variants = _case_variants().get(_fold(ch), ch)
    return f"[{variants}]" if len(variants) > 1 else ch


def atoms() -> dict[int, str]:
    """Code points to their pattern, where it is not the character itself."""
    found = {code: _atom(chr(code)) for code in (*range(0x80), ord("’"))}
    for variants in _case_variants().values():
        if len(variants) > 1:
            found |= {ord(ch): f"[{variants}]" for ch in variants}
    return found


def case_folds() -> tuple[str, str]:
    """Characters and what they fold to, so that what atoms match alike folds alike."""
    pairs = [(ch.upper(), ch) for ch in "abcdefghijklmnopqrstuvwxyz"] + [("’", "'")]
    for folded, variants in _case_variants().items():
        pairs += [(ch, folded) for ch in variants if ch != folded]
    return "".join(ch for ch, _ in pairs), "".join(folded for _, folded in pairs)


def _fold(ch: str) -> str:
    for folded in (ch.casefold(), ch.lower()):
        if len(folded) == 1:
            return folded
    return ch


@lru_cache(maxsize=1)
def _case_variants() -> dict[str, str]:
    """Non-ASCII characters by simple case folding.

    The matcher folds ASCII letters only: its Unicode folding would also take
    the dotless i for an i.
    """
    groups: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        ch = chr(code)
        if unicodedata.category(ch)[0] in "LMNS":
            folded = _fold(ch)
            if not folded.isascii():
                groups[folded] = groups.get(folded, "") + ch
    return groups

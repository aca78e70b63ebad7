"""The ordered rule list.

Order is part of the meaning: every rule sees the text the rule before it left.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from hushtext.functions.marks import protect_term
from hushtext.plans import fixed_values as fixed
from hushtext.plans.dictionary import alternation, dictionary_pattern
from hushtext.plans.options import Options

# Unicode classes and boundaries.  Case folding stays ASCII: the text is
# compatibility-normalized, so no other character folds to an ASCII letter.
EXACT = "(?U-u)"
ANY_CASE = "(?iU-u)"


@dataclass(frozen=True)
class Guard:
    """What a text must contain for a rule to have any chance of matching.

    ``symbol``: a string that must occur.
    ``stems``, ``words``: one of these must start at a word boundary, and a word
    must also end at one.  Lower-case ASCII letters, a stem may end in one mark.
    ``digits``: a pattern for the text with every run of non-digits cut down to
    one space.

    All are tested once, on the normalized text.  That stays sound for later
    rules: a replaced span leaves a bracketed token behind, so no new stretch of
    adjacent letters or digits can come about.  Only the rules that may stop
    inside a word (``cuts_words``) can lay open a new word start; where one of
    them has replaced something, later guards count as passed.
    """

    symbol: str | None = None
    stems: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    digits: str | None = None


@dataclass(frozen=True)
class Rule:
    """One find-and-replace pass."""

    id: str
    category: str
    pattern: str
    guard: Guard | None = None
    # matches that are clinical terms or saint names are left as they are
    keep_stop_terms: bool = False
    # a match may end inside a word
    cuts_words: bool = False
    # a table of terms to look up; the pattern is then what stands before them
    terms: DataFrame | None = None

    @property
    def token(self) -> str:
        return fixed.TOKENS[self.category]



def all_rules(options: Options) -> list[Rule]:
    """Every rule, in order of application."""

    def any_case(id_, category, body, **kw):
        return Rule(id_, category, ANY_CASE + body, **kw)

    def exact(id_, category, body, **kw):
        return Rule(id_, category, EXACT + body, **kw)

    def stems(*texts):
        return Guard(stems=texts)

    def words(*texts):
        return Guard(words=tuple(t.lower() for t in texts))

    def digits(pattern):
        return Guard(digits=pattern)

    low, high = options.mrn_min_length, options.mrn_max_length
    def dictionary(id_, category, terms, **kw):
        if isinstance(terms, DataFrame):
            return any_case(id_, category, "", terms=terms, **kw)
        # terms are spelled the way the text is while the rules run
        body = dictionary_pattern(map(protect_term, terms))
        return any_case(id_, category, body, guard=_dictionary_guard(terms), **kw)

    titles = [t + dot for t in fixed.SHORT_TITLES for dot in ("", ".")]
    titled = _name_after([*titles, *fixed.LONG_TITLES])
    first_last = _name_after(fixed.FIRST_NAMES)

    rules = [
        any_case("email", "email", fixed.EMAIL, guard=Guard(symbol="@")),
        any_case(
            "email_obfuscated",
            "email",
            fixed.EMAIL_OBFUSCATED,
            guard=words("dot"),
        ),
        any_case("url", "url", fixed.URL, guard=stems("http", "www.")),
        any_case(
            "phone", "phone", fixed.PHONE, guard=digits(r"\d{3} ?\d{3} ?\d{4}")
        ),
        exact("ssn", "ssn", fixed.SSN, guard=digits(r"\d{4}")),
        any_case(
            "mrn_label",
            "mrn",
            fixed.MRN_LABEL,
            guard=stems("mrn", "acct", "account", "patient", "chart"),
        ),
        exact(
            "mrn_digits",
            "mrn",
            fixed.MRN_DIGITS % (low, high),
            guard=digits(rf"\d{{{low}}}"),
        ),
        exact("zip", "zip", fixed.ZIP, guard=digits(r"\d{5}")),
        any_case(
            "facility_pattern",
            "facility",
            fixed.FACILITY_PATTERN,
            guard=Guard(
                stems=("st.", "mt.", "univ", "children"),
                words=("saint", "mount", "memorial", "general", "county"),
            ),
        ),
        dictionary("facility_dict", "facility", options.facility_terms),
        any_case(
            "address", "address", fixed.ADDRESS, guard=digits(r"\d"), cuts_words=True
        ),
        any_case(
            "location", "address", fixed.LOCATION, guard=digits(r"\d"), cuts_words=True
        ),
        any_case(
            "coordinate",
            "coordinate",
            fixed.COORDINATE,
            guard=digits(r"\d \d+ \d+ \d"),
        ),
        any_case(
            "insurance",
            "insurance",
            fixed.INSURANCE,
            guard=stems("member", "policy", "plan", "subscriber", "insurance"),
        ),
        any_case(
            "license",
            "license",
            fixed.LICENSE,
            guard=Guard(
                stems=("driver", "dl", "lic", "passport"), words=("state", "id")
            ),
        ),
        any_case(
            "vehicle",
            "vehicle",
            fixed.VEHICLE,
            guard=stems("vin", "vehicle", "plate", "tag"),
        ),
        any_case(
            "device",
            "device",
            fixed.DEVICE,
            guard=stems(
                "device", "implant", "pump", "pacemaker", "generator",
                "catheter", "serial", "s/",
            ),
        ),
        exact("ip", "ip", fixed.IP, guard=digits(r"\d \d{1,3} \d{1,3} \d")),
        dictionary(
            "person_dict", "person", options.surnames, keep_stop_terms=True
        ),
        any_case(
            "person_titled",
            "person",
            titled,
            guard=words(*fixed.SHORT_TITLES, *fixed.LONG_TITLES),
            keep_stop_terms=True,
        ),
        any_case(
            "person_first_last",
            "person",
            first_last,
            guard=words(*fixed.FIRST_NAMES),
            keep_stop_terms=_may_be_stop_term(fixed.FIRST_NAMES),
        ),
        exact(
            "person_capitals",
            "person",
            fixed.PERSON_CAPITALS,
            keep_stop_terms=True,
        ),
        any_case("date", "date", fixed.DATE, guard=digits(r"\d \d{2}")),
        any_case(
            "relative_date",
            "relative-date",
            fixed.RELATIVE_DATE,
            guard=words("yesterday", "today", "tomorrow", "last", "this", "ago"),
        ),
    ]
    return rules


def active_rules(
    options: Options, *, safe_harbor: bool = False, skip: Collection[str] = ()
) -> list[Rule]:
    """The rules that run for this mode; the others are never planned."""
    skip = {skip} if isinstance(skip, str) else set(skip)
    unknown = skip - set(fixed.TOKENS)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    if not safe_harbor:
        skip |= set(fixed.SAFE_HARBOR_ONLY)
    return [rule for rule in all_rules(options) if rule.category not in skip]


def _name_after(words: Iterable[str]) -> str:
    """One of the words, whitespace, then one or two further words."""
    return rf"(?=[a-z])\b{alternation(words)}{fixed.NAME_TAIL}"


def _may_be_stop_term(first_words: Iterable[str]) -> bool:
    """Whether a match that starts with one of the words could be a stop term.

    Line breaks do not count in the comparison, so "Mr", line break, "Sa" could.
    """
    starts = tuple(word.upper() for word in first_words)
    return "ST" in starts or any(t.startswith(starts) for t in fixed.STOP_TERMS)


def _dictionary_guard(terms: tuple[str, ...]) -> Guard | None:
    """The first words of the terms, or None if they are not plain enough."""
    first_words = [re.match(r"[A-Za-z]+(?!\w)", term) for term in terms]
    if not all(first_words):
        return None
    words = {m[0].lower() for m in first_words}
    # a term could also be found inside a token put in by an earlier rule
    if words & {token.strip("[]").lower() for token in fixed.TOKENS.values()}:
        return None
    return Guard(words=tuple(sorted(words)))


@dataclass(frozen=True)
class KeywordScan:
    """One search for the stems and words of many guards at once."""

    pattern: str
    stems: tuple[str, ...]

    @classmethod
    def of(cls, guards: Iterable[Guard]) -> KeywordScan:
        guards = list(guards)
        found = {s for g in guards for s in g.stems}
        stems = sorted(s for s in found if not any(_begins(s, o) for o in found))
        words = sorted({w for g in guards for w in g.words})
        scan = cls("", tuple(stems))
        alone = [w for w in words if scan.key(w) == w]
        body = alternation(stems, whole_words=alone)
        return cls(rf"{ANY_CASE}(?=[a-z])\b{body}", scan.stems)

    def key(self, keyword: str) -> str:
        """What the scan reports where ``keyword`` occurs: a shorter stem may
        stand for it."""
        return next((s for s in self.stems if keyword.startswith(s)), keyword)

    def test(self, guard: Guard) -> str | None:
        """Pattern for the space-separated, lower-case reports of the scan."""
        keys = sorted({self.key(k) for k in (*guard.stems, *guard.words)})
        return rf"(?:\A| ){alternation(keys)}" if keys else None


def _begins(text: str, other: str) -> bool:
    return text != other and text.startswith(other)


RULE_IDS = tuple(rule.id for rule in all_rules(Options()))

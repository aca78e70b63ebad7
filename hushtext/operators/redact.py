"""Redaction of a text column: one narrow chain of native projections."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.functions import marks
from hushtext.functions.linear import linear_function
from hushtext.functions.text import (
    contains_any,
    has_non_ascii,
    normalize_column,
    tidy_column,
    with_spaces_squeezed,
)
from hushtext.operators.lookup import with_patterns
from hushtext.operators.report import counts_struct, counts_total
from hushtext.plans.fixed_values import COUNT_FIELDS, STOP_TERMS
from hushtext.plans.linear import linear_steps
from hushtext.plans.options import Options
from hushtext.plans.rules import (
    ANY_CASE,
    KeywordScan,
    Rule,
    active_rules,
    all_rules,
)

REDACTED = "redacted"
COUNTS = "redaction_counts"
TOTAL = "redactions_total"

# working columns; none of them leaves the operators
_PREFIX = "__hush_"
_NFKC = _PREFIX + "nfkc"
_TEXT = _PREFIX + "text"
_MARKED = _PREFIX + "marked"
_KEYWORDS = _PREFIX + "keywords"
_DIGITS = _PREFIX + "digits"
_PLAIN = _PREFIX + "plain"
_FOUND = _PREFIX + "found"

# Longer ASCII texts go the way of the others: a batch for Python has up to 10,000 texts,
# so this bounds it
_PLAIN_BYTES = 16_384

# rules between two ``_pause``s
_RULES_PER_METHOD = 4


def redact(
    df: DataFrame,
    text_col: str = "text",
    *,
    safe_harbor: bool = False,
    skip: Collection[str] = (),
    config: Options | Mapping[str, Any] | None = None,
    counts: bool = True,
    text: bool = True,
) -> DataFrame:
    """Add ``redacted``, ``redaction_counts`` and ``redactions_total``.

    Works on batch and streaming DataFrames alike: there is no shuffle and no
    state.  Only a dictionary too long for a pattern is joined, in batches.  All
    input columns are kept; a null text gives a null ``redacted`` and zero counts.
    ``counts=False`` adds ``redacted`` only; ``text=False`` adds the counts only, for
    summaries and reports, and leaves out the work on the text after the last rule.
    """
    if not (counts or text):
        raise ValueError("neither text nor counts are wanted")
    rules = active_rules(_options(config), safe_harbor=safe_harbor, skip=skip)
    added = [REDACTED] * text + [COUNTS, TOTAL] * counts
    _check_columns(df, added)

    work, found = _normalized(df, F.col(text_col), rules, text)
    work, tallies = _apply(work, rules)
    if text or tallies:
        work = _pause(work, [_TEXT] * text + list(tallies.values()))
    if text:
        work = tidy_column(work, _TEXT)
        if found:
            work = work.withColumn(_TEXT, F.coalesce(F.col(found)["text"], F.col(_TEXT)))
        work = work.withColumn(REDACTED, marks.unprotect(_TEXT))
    if counts:
        per_category: dict[str, list[str]] = {}
        for rule in rules:
            per_category.setdefault(rule.category, []).append(tallies[rule.id])
        work = work.withColumn(COUNTS, counts_struct(per_category, found))
        work = work.withColumn(TOTAL, counts_total(COUNTS))
    return _seal(work, df.columns, added)


def _normalized(
    df: DataFrame, source: Column, rules: list[Rule], text: bool
) -> tuple[DataFrame, str | None]:
    """Add the working text, and what the rules make of it where it is ASCII.

    Both matchers find the same.  The one for ASCII is several times faster; where it has
    a result the working text is null, which the rules after it pass over.
    """
    linear = linear_steps(rules, _STOP_PATTERN) if rules else None
    if linear is None:
        return normalize_column(df, source, _NFKC, _TEXT), None
    # a byte that is no UTF-8 counts as a character as well
    plain = ~has_non_ascii(source) & F.is_valid_utf8(source)
    short = F.octet_length(source) <= _PLAIN_BYTES
    df = df.withColumn(_PLAIN, F.when(plain & short, source))
    df = with_spaces_squeezed(df.withColumn(_PLAIN, marks.protect(_PLAIN)), _PLAIN)
    fields = {category: field for field, category in COUNT_FIELDS.items()}
    found = linear_function(*linear, fields, text)(_PLAIN)
    rest = F.when(F.col(_PLAIN).isNull(), source)
    df = normalize_column(df, rest, _NFKC, _TEXT, {_FOUND: found})
    return df.drop(_PLAIN), _FOUND


def redact_rule(
    df: DataFrame,
    text_col: str,
    rule_id: str,
    *,
    config: Options | Mapping[str, Any] | None = None,
) -> DataFrame:
    """Run one rule alone on the normalized text.

    Adds ``redacted`` (not tidied) and ``n``, the number of replacements.
    """
    rules = [r for r in all_rules(_options(config)) if r.id == rule_id]
    if not rules:
        raise ValueError(f"unknown rule: {rule_id!r}")
    _check_columns(df, [REDACTED, "n"])
    work, tallies = _apply(normalize_column(df, F.col(text_col), _NFKC, _TEXT), rules)
    number = F.coalesce(F.col(tallies[rule_id]), F.lit(0).cast("long"))
    work = work.withColumns({REDACTED: marks.unprotect(_TEXT), "n": number})
    return _seal(work, df.columns, [REDACTED, "n"])


def _seal(work: DataFrame, kept: list[str], added: list[str]) -> DataFrame:
    """Hand out the results through a generator of one row.

    A filter on a result must not be moved below the chain: it would have to
    repeat every rule, and twice as often with each of them.  The optimizer moves
    no filter on a generated column, while filters on the other columns still
    reach the scan.
    """
    results = F.struct(*[F.col(name) for name in added])
    names = ["`" + c.replace("`", "``") + "`" for c in kept]
    return work.select(*[F.col(c) for c in names], F.inline(F.array(results)))


def _pause(df: DataFrame, names: list[str]) -> DataFrame:
    """The same columns, ``names`` handed on by a generator of one row.

    Spark writes a chain of projections as one Java method, and a JVM only interprets a
    method of more than 8,000 bytes.  What follows a generator is a method of its own.
    """
    kept = [c for c in df.columns if c not in names and c not in (_MARKED, _NFKC)]
    return _seal(df, kept, names)


def _options(config: Options | Mapping[str, Any] | None) -> Options:
    if isinstance(config, Options):
        return config
    return Options.from_mapping(config or {})


def _check_columns(df: DataFrame, added: list[str]) -> None:
    taken = [c for c in df.columns if c in added or c.startswith(_PREFIX)]
    if taken:
        raise ValueError(f"input already has the columns {taken}")


def _apply(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, dict[str, str]]:
    """Apply rules in order to the working text.

    Every step is a projection of its own.  The text is used more than once per
    step, so a single nested expression would double with each rule.
    """
    df, flags = _with_guards(df, rules)
    if flags:
        df = _pause(df, [_TEXT, *flags.values()])
    tallies: dict[str, str] = {}
    pending: dict[str, Column] = {}
    cuts: list[str] = []

    for at, rule in enumerate(rules):
        if at and at % _RULES_PER_METHOD == 0:
            if pending:
                df, pending = df.withColumns(pending), {}
            recent = [tallies[r.id] for r in rules[at - _RULES_PER_METHOD : at]]
            df = _pause(df, [_TEXT, *recent])
        name = tallies[rule.id] = _PREFIX + "n_" + rule.id
        mark = f"{marks.OPEN}$0{marks.CLOSE}" if rule.keep_stop_terms else marks.OPEN
        pattern = F.lit(rule.pattern)
        if rule.terms is not None:
            if pending:
                df, pending = df.withColumns(pending), {}
            patterns = f"{name}_pattern"
            df = with_patterns(df, _TEXT, rule.terms, rule.pattern, patterns)
            pattern = F.col(patterns)
        found = F.regexp_replace(_TEXT, pattern, F.lit(mark))
        if rule.terms is not None:
            found = F.coalesce(found, F.col(_TEXT))
        if rule.id in flags:
            flag = flags[rule.id]
            if rule.guard.stems or rule.guard.words:
                flag = " or ".join([flag, *(f"{cut} > 0" for cut in cuts)])
            found = F.when(F.expr(flag), found).otherwise(F.col(_TEXT))
        df = df.withColumns(pending | {_MARKED: found})
        if rule.keep_stop_terms:
            df = df.withColumn(_MARKED, _unbracket_stop_terms())
            tokens = f"regexp_replace({_MARKED}, '{_BRACKETED}', '{rule.token}')"
            pending, count = {}, {name: _count_marks()}
        else:
            tokens = f"array_join(split({_MARKED}, '{marks.OPEN}'), '{rule.token}')"
            # each mark grows into a token, so the lengths tell how many
            pending, count = {name: _grown_by(len(rule.token) - marks.WIDTH)}, {}
        replaced = F.expr(
            f"if(contains({_MARKED}, '{marks.OPEN}'), {tokens}, {_MARKED})"
        )
        df = df.withColumns({_TEXT: replaced} | count)
        if rule.cuts_words:
            cuts.append(name)
    return (df.withColumns(pending) if pending else df), tallies


def _grown_by(width: int) -> Column:
    return F.expr(
        f"cast((octet_length({_TEXT}) - octet_length({_MARKED})) div {width} as long)"
    )


def _with_guards(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, dict[str, str]]:
    """Add one boolean per guarded rule.

    Two side texts, the keywords and the digits of the text, are searched instead
    of the text itself; as a rule they are very short.
    """
    guards = {rule.id: rule.guard for rule in rules if rule.guard}
    scan = KeywordScan.of(guards.values())
    keywords = F.regexp_extract_all(_TEXT, F.lit(scan.pattern), F.lit(0))
    digits = F.regexp_replace(_TEXT, r"(?U)\D++", " ")
    some = contains_any(_TEXT, "0123456789") | has_non_ascii(_TEXT)
    side: dict[str, Column] = {}
    flags: dict[str, Column] = {}
    for rule_id, guard in guards.items():
        tests = []
        if guard.symbol:
            tests.append(F.contains(_TEXT, F.lit(guard.symbol)))
        if guard.stems or guard.words:
            side[_KEYWORDS] = F.lower(F.array_join(keywords, " "))
            tests.append(F.col(_KEYWORDS).rlike(scan.test(guard)))
        if guard.digits:
            side[_DIGITS] = F.when(some, digits).otherwise("")
            tests.append(F.col(_DIGITS).rlike("(?U)" + guard.digits))
        flags[_PREFIX + "may_" + rule_id] = reduce(and_, tests)
    if flags:
        df = (df.withColumns(side) if side else df).withColumns(flags)
    return df, {rule_id: _PREFIX + "may_" + rule_id for rule_id in guards}


# --- matches that may turn out to be clinical terms ---------------------------


_BRACKETED = f"{marks.OPEN}[^{marks.CLOSE}]*+{marks.CLOSE}"


def _stop_pattern() -> str:
    """A bracketed match that is a saint's name or, letters only, a stop term.

    A rejected match keeps its text but has used it up, which is why this is not
    a lookahead inside the rule: that would try again within the rejected text.
    """
    dropped = rf"[^\p{{IsAlphabetic}}\p{{N}} {marks.CLOSE}]*+"
    edge = rf"[^\p{{IsAlphabetic}}\p{{N}}{marks.CLOSE}]*+"
    terms = "|".join(
        dropped.join("[Iı]" if ch == "I" else ch for ch in term)
        for term in STOP_TERMS
        if all(ch.isalnum() or ch == " " for ch in term)
    )
    return (
        rf"{ANY_CASE}{marks.OPEN}"
        rf"(\s*+st\.? [^{marks.CLOSE}]*+|{edge}(?:{terms}){edge}){marks.CLOSE}"
    )


_STOP_PATTERN = _stop_pattern()


def _unbracket_stop_terms() -> Column:
    kept = F.regexp_replace(_MARKED, _STOP_PATTERN, "$1")
    return F.when(marks.has_mark(_MARKED), kept).otherwise(F.col(_MARKED))


def _count_marks() -> Column:
    return F.expr(
        f"if(contains({_MARKED}, '{marks.OPEN}'), cast((octet_length({_MARKED}) - "
        f"octet_length(replace({_MARKED}, '{marks.OPEN}', ''))) div {marks.WIDTH} "
        "as long), 0L)"
    )

"""Text normalization before the rules and tidying after them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushtext.functions import marks
from hushtext.plans.dictionary import WHITE_SPACE
from hushtext.plans.fixed_values import SYMBOL_FOLDS


def _nfkc_function():
    # a local function travels by value: workers need not have this package
    def normalize(texts: pa.Array) -> pa.Array:
        # one text at a time, so that besides the batch only its result is kept
        found = (text.as_py() for text in texts)
        forms = (text and unicodedata.normalize("NFKC", text) for text in found)
        return pa.array(forms, pa.string(), size=len(texts))

    return F.arrow_udf(normalize, T.StringType())


_nfkc = _nfkc_function()


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def has_non_ascii(text: Column | str) -> Column:
    """True if the text holds anything outside ASCII; only counts bytes."""
    return F.octet_length(text) > F.char_length(text)


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC.

    Spark has no native function for it.  Text of which no character can change
    or combine is its own NFKC form, so only other text crosses over to the Arrow
    function.
    """
    text = _col(text)
    return F.coalesce(nfkc_or_null(text), text)


def nfkc_or_null(text: Column) -> Column:
    """NFKC of non-ASCII text; null for ASCII text, which needs nothing."""
    changed = _nfkc(F.when(may_change_by_nfkc(text), text))
    return F.when(has_non_ascii(text), F.coalesce(changed, text))


def may_change_by_nfkc(text: Column | str) -> Column:
    """False only if the text surely is its own NFKC form.

    This is the quick check of the Unicode standard: true if a character changes
    alone, combines with the one before, or has an order among combining marks.
    """
    text = _col(text)
    return has_non_ascii(text) & text.rlike(_nfkc_pattern())


@cache
def nfkc_spans() -> tuple[tuple[int, int], ...]:
    """Ranges of the code points that NFKC can change or combine, from Python's tables.

    Unassigned code points between two of them count as well.
    """
    combining = set(range(0x1160, 0x1200))  # Korean letters are combined by rule
    odd = set()
    # the other planes hold nothing or private characters
    codes = list(chain(range(0x40000), range(0xE0000, 0xF0000)))
    for code in codes:
        ch = chr(code)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<":
            combining.update(int(part, 16) for part in parts.split()[1:])
        if unicodedata.combining(ch) or (parts and unicodedata.normalize("NFKC", ch) != ch):
            odd.add(code)
    odd |= combining
    spans: list[list[int]] = []
    open_ = False
    for code in codes:
        if code in odd:
            if open_:
                spans[-1][1] = code
            else:
                spans.append([code, code])
            open_ = True
        elif open_:
            open_ = unicodedata.category(chr(code)) == "Cn"
    return tuple((first, last) for first, last in spans)


_COMMON_RANGES = 12
_CLASS_RANGES = 16


@cache
def _nfkc_pattern() -> str:
    """A character within ``nfkc_spans``.

    A class tries its ranges one by one, so ranges without such a character that hold
    nearly all text in use are ruled out first: those of dashes, quotes and bullets, then
    those of the alphabets up to U+0700 and the longest of the rest.
    """
    spans = nfkc_spans()
    ends = [-1, *(last for _, last in spans)]
    free = [(end + 1, first - 1) for end, (first, _) in zip(ends, spans, strict=False)]
    plain, *free = [r for r in free if r[0] < 0x10000]
    signs = [r for r in free if 0x2010 <= r[0] < 0x2040]
    letters = [r for r in free if r[0] < 0x700 and r[1] - r[0] >= 30]
    longest = sorted(set(free) - set(letters), key=lambda r: r[0] - r[1])
    common = letters + longest[:_COMMON_RANGES]

    def ranges(some) -> str:
        return "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in some)

    parts = [
        f"[{ranges(spans[i : i + _CLASS_RANGES])}]" for i in range(0, len(spans), _CLASS_RANGES)
    ]
    ordinary = "&&".join(f"[^{ranges(some)}]" for some in ([plain], signs, common))
    return f"[{ordinary}&&[{''.join(parts)}]]"


def contains_any(text: str, needles: Iterable[str]) -> Column:
    """True if any of the strings occurs in the column: byte searches, no decoding.

    One SQL text instead of a tree of columns: plans with many needles are built
    several times faster.  Needles must hold no quote and no backslash.
    """
    return F.expr(" or ".join(f"contains({text}, '{needle}')" for needle in needles))


def fold_symbols(text: Column | str, only: str | None = None) -> Column:
    """Fold typographic apostrophes, quotes, dashes and bullets to plain ones.

    ``only`` limits the folding to one target character.
    """
    folds = SYMBOL_FOLDS if only is None else {only: SYMBOL_FOLDS[only]}
    symbols = "".join(folds.values())
    plain = "".join(ch * len(variants) for ch, variants in folds.items())
    return F.translate(text, symbols, plain)


def squeeze_spaces(text: Column | str) -> Column:
    """Each run of whitespace other than CR and LF becomes one space.

    Lone spaces, by far the most common run, are not matched at all.
    """
    return F.regexp_replace(
        text, r"(?U) [^\S\r\n]++|[^\S\r\n ][^\S\r\n]*+", " "
    )


def normalize_text(text: Column | str) -> Column:
    """NFKC, symbol folds, squeezed spaces: what every rule expects."""
    return squeeze_spaces(fold_symbols(nfkc(text)))


def strip_space_before_punctuation(text: Column | str) -> Column:
    """Delete whitespace, line breaks too, in front of ``. , ; : ! ?``."""
    return F.regexp_replace(text, r"(?U)\s(?<!\s\s)\s*+(?=[.,;:!?])", "")


def squeeze_punctuation(text: Column | str) -> Column:
    """A run of ``. , ; : ! ?`` becomes its last character."""
    return F.regexp_replace(text, r"[.,;:!?]+(?=[.,;:!?])", "")


def trim_whitespace(text: Column | str) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tidy_text(text: Column | str) -> Column:
    """Clean up the punctuation around replaced spans and trim."""
    return trim_whitespace(squeeze_punctuation(strip_space_before_punctuation(text)))


# --- the same steps for a working column, run only on texts that need them ----

# what is left of WHITE_SPACE after NFKC, apart from the plain space, CR and LF
_ODD_ASCII_SPACES = "\t\x0b\f"
_ODD_OTHER_SPACES = "\x85\u1680\u2028\u2029"


def with_spaces_squeezed(df: DataFrame, name: str) -> DataFrame:
    """Replace ``name``, a text with marks protected, where it has spaces to squeeze."""
    spaced = contains_any(name, ["  ", *_ODD_ASCII_SPACES]) | (
        has_non_ascii(name) & contains_any(name, _ODD_OTHER_SPACES)
    )
    return df.withColumn(name, F.when(spaced, squeeze_spaces(name)).otherwise(F.col(name)))


def normalize_column(
    df: DataFrame,
    source: Column,
    nfkc_name: str,
    name: str,
    beside: Mapping[str, Column] | None = None,
):
    """Add ``name``, the normalized form of ``source``.

    ``beside`` are columns to add along with NFKC, as one Python step can hold several.

    ``translate`` takes a text apart character by character and a pattern has to
    decode it, so both wait for a byte search to find them something to do.
    Only non-ASCII text goes through NFKC and the folds, and only what NFKC could
    change leaves the JVM for it.
    """
    symbols = "".join(SYMBOL_FOLDS.values())
    folded = F.when(
        contains_any(nfkc_name, symbols), fold_symbols(nfkc_name)
    ).otherwise(F.col(nfkc_name))
    df = (
        df.withColumns({nfkc_name: nfkc_or_null(source)} | dict(beside or {}))
        .withColumn(nfkc_name, folded)
        .withColumn(name, F.coalesce(F.col(nfkc_name), source))
        .withColumn(name, marks.protect(name))
    )
    return with_spaces_squeezed(df, name)


def tidy_column(df: DataFrame, name: str) -> DataFrame:
    """Replace ``name``, a normalized text, by its tidied form."""
    ends = " or ".join(
        f"startswith({name}, '{ch}') or endswith({name}, '{ch}')" for ch in "\n\r "
    )
    return df.withColumn(
        name, squeeze_punctuation(strip_space_before_punctuation(name))
    ).withColumn(
        name, F.when(F.expr(ends), trim_whitespace(name)).otherwise(F.col(name))
    )

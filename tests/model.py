"""One text at a time in plain Python: what the Spark plan has to compute.

Written for clarity from the plain patterns; used as brute force in tests.
"""

import unicodedata

import regex

import sql_oracle
from hushtext.plans import fixed_values as fixed
from hushtext.plans.dictionary import WHITE_SPACE

SPACE = f"[{WHITE_SPACE}]"
ODD_SPACE = f"[{WHITE_SPACE}]".replace("\r", "").replace("\n", "")


def normalize(text):
    text = unicodedata.normalize("NFKC", text)
    for plain, variants in fixed.SYMBOL_FOLDS.items():
        for ch in variants:
            text = text.replace(ch, plain)
    return regex.sub(f"{ODD_SPACE}+", " ", text)


def tidy(text):
    text = regex.sub(f"{SPACE}+([.,;:!?])", r"\1", text)
    text = regex.sub("[.,;:!?]{2,}", lambda m: m[0][-1], text)
    return text.strip(WHITE_SPACE)


def is_stop_term(match):
    match = match.strip(WHITE_SPACE)
    if match.lower().startswith(("st. ", "st ")):
        return True
    kept = [ch for ch in match if ch == " " or regex.match(r"[\p{Alphabetic}\p{N}]", ch)]
    return "".join(kept).upper().strip(" ") in fixed.STOP_TERMS


def redacted_by_hand(text, safe_harbor=False, skip=(), **options):
    """Return the redacted text and the counts that are not zero."""
    if text is None:
        return None, {}
    text = normalize(text)
    counts = {}
    rules = sql_oracle.patterns(**options, **sql_oracle.NATIVE)
    fields = {category: field for field, category in fixed.COUNT_FIELDS.items()}
    for rule, pattern in rules.items():
        category = sql_oracle.CATEGORY[rule]
        if category in skip:
            continue
        if category in fixed.SAFE_HARBOR_ONLY and not safe_harbor:
            continue
        pieces, end, n = [], 0, 0
        for m in regex.finditer(pattern, text):
            if category == "person" and is_stop_term(m[0]):
                continue
            pieces += [text[end : m.start()], fixed.TOKENS[category]]
            end, n = m.end(), n + 1
        text = "".join(pieces) + text[end:]
        if n:
            counts[fields[category]] = counts.get(fields[category], 0) + n
    return tidy(text), counts

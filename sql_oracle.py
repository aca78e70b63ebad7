"""The same results as plain SQL for DuckDB, for checking only.

DuckDB matches with RE2: its ``\\b`` and ``\\w`` know ASCII only.  So that word
boundaries come out right next to accented letters, a text is first spelled with
ASCII word characters around every run of them (``na_1_i_1_ve``; a real underscore
becomes ``_0_``), all rules run on that, and the spelling is undone at the end.
The patterns here state what has to match, in the plainest form; the package uses forms
rewritten for linear time, which they check.
"""

from __future__ import annotations

from hushtext.plans import fixed_values as fixed
from hushtext.plans.dictionary import WHITE_SPACE

OPEN, CLOSE = "﷐", "﷑"
LATIN = r"\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
WORD = rf"\w{LATIN}"
NAME = rf"(?:[A-Za-z{LATIN}’']|_1_)+"
NAME_DASH = rf"(?:[A-Za-z{LATIN}’'-]|_1_)+"
FACILITY_WORD = rf"[A-Z](?:[A-Za-z0-9{LATIN}’'.-]|_1_)+"
# the same for a matcher that knows Unicode
NATIVE = {
    "word": r"\w",
    "name": r"[\p{L}’']+",
    "name_dash": r"[\p{L}’'-]+",
    "facility_word": r"[A-Z][\p{L}\p{M}\p{N}’'.-]+",
}
SPACES = "".join(rf"\x{{{ord(ch):X}}}" for ch in WHITE_SPACE)
ODD_SPACES = "".join(rf"\x{{{ord(ch):X}}}" for ch in WHITE_SPACE if ch not in "\r\n")
# fixed values: this pattern and those of ``patterns`` must match the same texts as the
# rules they check, so they are stated as they are
_ID_TAIL = r"[A-Z0-9]{3,}(?:[-\s][A-Z0-9]{2,}){0,3}\b"


class Sql(str):
    """SQL for a string, where a literal could stand as well."""


def text(value: str) -> str:
    """A SQL string literal."""
    if isinstance(value, Sql):
        return value
    return "'" + value.replace("'", "''") + "'"


def _words(terms) -> str:
    escape = str.maketrans({ch: "\\" + ch for ch in r"\.+*?()|[]{}^$#&-~"})
    return "|".join(t.translate(escape).replace("'", "[’']") for t in terms)


def _listed(defaults, extra) -> str:
    terms = {t.strip(WHITE_SPACE) for t in extra} - {""}
    return _words(sorted(terms.union(defaults)))


def names_of(column: str, table: str) -> Sql:
    """Pattern of the surnames and the terms in a column of a table, as a subquery."""
    values = ", ".join(f"({text(t)})" for t in fixed.SURNAMES)
    escaped = swap("term", r"([\\.+*?()|\[\]{}^$#&~-])", r"\\\1")
    listed = swap(spell(escaped), "'", "[’']")
    return Sql(
        "(SELECT '(?i)\\b(?:' || string_agg(" + listed + ", '|' ORDER BY term) || ')\\b' FROM ("
        f"SELECT {trim(column)} AS term FROM {table} UNION SELECT col0 FROM (VALUES {values})"
        ") WHERE term <> '')"
    )


def patterns(
    names=(),
    keywords=(),
    low=6,
    high=10,
    *,
    word=WORD,
    name=NAME,
    name_dash=NAME_DASH,
    facility_word=FACILITY_WORD,
) -> dict[str, str]:
    """Plain pattern of every rule, in order."""
    titles = "|".join(
        [rf"{t}\.?" for t in fixed.SHORT_TITLES] + list(fixed.LONG_TITLES)
    )
    rest = rf"\s+[A-Z]{name_dash}(?:\s+[A-Z]{name_dash})?"
    facilities = _listed(fixed.FACILITY_TERMS, keywords)
    surnames = names
    if not isinstance(names, Sql):
        surnames = rf"(?i)\b(?:{_listed(fixed.SURNAMES, names)})\b"
    return {
        "email": rf"(?i)\b[{word}.+%-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b",
        "email_obfuscated": rf"(?i)\b[{word}.+-]+(?:\s+at\s+|\s*@\s*)[{word}.-]+"
        rf"(?:\s+dot\s+[{word}.-]+)+\b",
        "url": r"(?i)\b(?:https?://|www\.)\S+",
        "phone": r"(?i)\b(?:\+?1[-.\s•·]?)?(?:\(?\d{3}\)?|\d{3})[-.\s•·]?\d{3}"
        r"[-.\s•·]?\d{4}(?:\s*(?:x|ext\.?|extension)\s*\d{1,6})?\b",
        "ssn": r"\b(?:\d{3}-\d{2}-\d{4}|xxx-xx-\d{4})\b",
        "mrn_label": r"(?i)\b(?:MRN|Acct|Account|Patient\s*ID|Chart)\s*[:#]?\s*-?\s*"
        r"[A-Za-z0-9-]{4,}\b",
        "mrn_digits": rf"\b\d{{{low},{high}}}\b",
        "zip": r"\b\d{5}(?:-\d{4})?\b",
        "facility_pattern": r"(?i)\b(?:St\.|Saint|Mt\.|Mount|Univ\.|University"
        r"|Memorial|Children'?s|General|County)\s+"
        rf"(?:{facility_word}(?:\s+{facility_word}){{0,4}})"
        r"(?:\s+(?:Hospital|Med(?:ical)?\s*Center|Clinic|Health(?:care)?"
        r"|Infirmary))?\b",
        "facility_dict": rf"(?i)\b(?:{facilities})\b",
        "address": r"(?i)\b\d{1,6}\s+(?:[NSEW]\.?\s+)?"
        rf"(?:\d+(?:st|nd|rd|th)|[A-Z][{word}.-]*)"
        rf"(?:\s+(?:\d+(?:st|nd|rd|th)|[A-Z][{word}.-]*)){{0,3}}"
        r"\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Drive|Dr\.?|Boulevard"
        r"|Blvd\.?|Lane|Ln\.?|Court|Ct\.?|Place|Pl\.?|Terrace|Ter\.?|Way)"
        r"(?:\s*,?\s*(?:Apt|Apartment|Unit|Suite|Ste\.?|#)\s*[-A-Z0-9]+)?",
        "location": r"(?i)\b(?:Suite|Ste\.?|Room|Rm\.?|Unit|Apt|Apartment|OR|Bed"
        r"|Bay)\s*-?\s*(?:#?\d[0-9A-Z-]{0,5})",
        "coordinate": r"(?i)\b-?\d{1,3}\.\d+\s*(?:°|º)?\s*[NS]\b[,;\s]*"
        r"-?\d{1,3}\.\d+\s*(?:°|º)?\s*[EW]\b",
        "insurance": r"(?i)\b(?:Member|Policy|Plan|Subscriber|Insurance)\s*"
        rf"(?:ID|No\.?|Number|#)?\s*[:#-]?\s*{_ID_TAIL}",
        "license": r"(?i)\b(?:Driver'?s\s+License|DL|License|Lic|Passport"
        rf"|State\s+ID|ID\s+Number)\s*(?:No\.?|Number|ID|#)?\s*[:#-]?\s*{_ID_TAIL}",
        "vehicle": r"(?i)\b(?:VIN|Vehicle\s+Identification\s+Number|Plate|Tag)\s*"
        r"(?:No\.?|Number|ID|#)?\s*[:#-]?\s*[A-HJ-NPR-Z0-9]{5,17}\b",
        "device": r"(?i)\b(?:Device|Implant|Pump|Pacemaker|Generator|Catheter|Serial"
        r"|S/N)\s*(?:ID|No\.?|Number|#)?\s*[:#-]?\s*"
        r"[A-Z0-9]{3,}(?:[-/][A-Z0-9]{2,}){0,3}\b",
        "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
        "person_dict": surnames,
        "person_titled": rf"(?i)\b(?:{titles}){rest}",
        "person_first_last": rf"(?i)\b(?:{_words(fixed.FIRST_NAMES)}){rest}",
        "person_capitals": rf"\b[A-Z]{name}\s+[A-Z]{name}(?:\s+[A-Z]{name})?\b",
        "date": r"(?i)\b(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})|\d{4}-\d{2}-\d{2}"
        r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+"
        r"\d{1,2},?\s+\d{2,4})\b",
        "relative_date": r"(?i)\b(yesterday|today|tomorrow|last\s+(?:night|week|month"
        r"|year|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
        r"|this\s+(?:morning|afternoon|evening|week|month)"
        r"|\d+\s+(?:day|days|week|weeks|month|months|year|years)\s+ago)\b",
    }


CATEGORY = {
    "email": "email", "email_obfuscated": "email", "url": "url",
    "phone": "phone", "ssn": "ssn", "mrn_label": "mrn", "mrn_digits": "mrn",
    "zip": "zip", "facility_pattern": "facility", "facility_dict": "facility",
    "address": "address", "location": "address", "coordinate": "coordinate",
    "insurance": "insurance", "license": "license", "vehicle": "vehicle",
    "device": "device", "ip": "ip", "person_dict": "person",
    "person_titled": "person", "person_first_last": "person",
    "person_capitals": "person", "date": "date",
    "relative_date": "relative-date",
}

_GAP = rf"[^\p{{L}}\p{{N}} {CLOSE}]*"
_EDGE = rf"[^\p{{L}}\p{{N}}{CLOSE}]*"
_STOP = (
    rf"(?i){OPEN}(\s*st\.? [^{CLOSE}]*|{_EDGE}(?:"
    + "|".join(_GAP.join(t) for t in fixed.STOP_TERMS if "." not in t)
    + rf"){_EDGE}){CLOSE}"
)


def swap(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {text(pattern)}, {text(by)}, 'g')"


def normalize(expr: str) -> str:
    symbols = "".join(fixed.SYMBOL_FOLDS.values())
    plain = "".join(k * len(v) for k, v in fixed.SYMBOL_FOLDS.items())
    folded = f"translate(nfc_normalize({expr}), {text(symbols)}, {text(plain)})"
    return swap(folded, f"[{ODD_SPACES}]+", " ")


def tidy(expr: str) -> str:
    expr = swap(expr, rf"[{SPACES}]+([.,;:!?])", r"\1")
    expr = swap(expr, r"[.,;:!?]+([.,;:!?])", r"\1")
    return trim(expr)


def trim(expr: str) -> str:
    return swap(expr, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def spell(expr: str) -> str:
    return swap(f"replace({expr}, '_', '_0_')", f"([{LATIN}]+)", r"_1_\1_1_")


def unspell(expr: str) -> str:
    return f"replace({swap(expr, f'_1_([{LATIN}]+)_1_', chr(92) + '1')}, '_0_', '_')"


def chain(
    source: str,
    keep: list[str],
    rule_ids=None,
    safe_harbor=False,
    skip=(),
    tidied=True,
    **options,
) -> str:
    """``WITH`` clause that ends in a relation ``redacted_rows``.

    Its columns are ``keep``, ``redacted`` and ``n_<rule>`` for every rule.
    """
    ctes = [
        "step0 AS MATERIALIZED (SELECT "
        + "".join(f"{c}, " for c in keep)
        + f"{spell(normalize('text'))} AS t FROM ({source}))"
    ]
    last = "step0"
    for number, (rule, pattern) in enumerate(patterns(**options).items(), start=1):
        category = CATEGORY[rule]
        if rule_ids is not None:
            active = rule in rule_ids
        else:
            active = category not in skip and (
                safe_harbor or category not in fixed.SAFE_HARBOR_ONLY
            )
        if not active:
            continue
        token = fixed.TOKENS[category]
        if category == "person":
            marked = swap(swap("t", pattern, rf"{OPEN}\0{CLOSE}"), _STOP, r"\1")
            after = swap("m", f"{OPEN}[^{CLOSE}]*{CLOSE}", token)
        else:
            marked = swap("t", pattern, OPEN)
            after = f"replace(m, '{OPEN}', '{token}')"
        ctes.append(
            f"step{number} AS MATERIALIZED (SELECT * EXCLUDE (t, m), {after} AS t, "
            f"length(m) - length(replace(m, '{OPEN}', '')) AS n_{rule} "
            f"FROM (SELECT *, {marked} AS m FROM {last}))"
        )
        last = f"step{number}"
    final = tidy(unspell("t")) if tidied else unspell("t")
    ctes.append(
        f"redacted_rows AS (SELECT * EXCLUDE (t), {final} AS redacted FROM {last})"
    )
    return "WITH " + ", ".join(ctes)


def counts(rule_ids=None, safe_harbor=False, skip=()) -> dict[str, str]:
    """Counter field -> SQL over the ``n_<rule>`` columns of ``chain``."""
    sums = {}
    for field, category in fixed.COUNT_FIELDS.items():
        off = category in skip or (
            not safe_harbor and category in fixed.SAFE_HARBOR_ONLY
        )
        parts = [f"n_{rule}" for rule, c in CATEGORY.items() if c == category]
        sums[field] = "0" if off else "(" + " + ".join(parts) + ")"
    return sums

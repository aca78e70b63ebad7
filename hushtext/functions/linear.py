"""All rules on ASCII texts in one Arrow function."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from hushtext.functions.marks import CLOSE, OPEN

# texts are taken through the rules some at a time, so that what is kept besides the
# batch and its result is small; each time the patterns are made anew, some 25 ms
_SLICE_BYTES = 8 << 20


def linear_function(steps: Sequence, stop: str, fields: Mapping[str, str], text: bool):
    """A function of a normalized ASCII text: a struct of the counts, and of the tidied text.

    ``fields`` names the counter of each category.  A null text gives nulls.
    """
    # plain values, as a local function travels by value: workers need not have this package
    plan = [(s.pattern, s.token, fields[s.category], s.keep_stop_terms) for s in steps]
    counters = [f for f in fields.values() if any(f == field for _, _, field, _ in plan)]
    names = ["text"] * text + counters
    left, right, most = OPEN, CLOSE, _SLICE_BYTES

    def of_slice(texts: pa.Array) -> pa.Array:
        counts = {}
        for pattern, token, field, keep_stop_terms in plan:
            if keep_stop_terms:
                texts = pc.replace_substring_regex(texts, pattern, rf"{left}\0{right}")
                texts = pc.replace_substring_regex(texts, stop, r"\1")
                marked = pc.replace_substring_regex(texts, f"{left}[^{right}]*{right}", left)
            else:
                marked = pc.replace_substring_regex(texts, pattern, left)
            texts = pc.replace_substring(marked, left, token)
            # each mark grows into a token, so the lengths tell how many
            grown = pc.subtract(pc.binary_length(texts), pc.binary_length(marked))
            n = pc.divide(pc.cast(grown, pa.int64()), len(token) - len(left))
            counts[field] = pc.add(counts[field], n) if field in counts else n
        found = [counts[field] for field in counters]
        if text:
            texts = pc.replace_substring_regex(texts, r"[\t-\r ]+([.,;:!?])", r"\1")
            texts = pc.replace_substring_regex(texts, r"[.,;:!?]+([.,;:!?])", r"\1")
            found = [pc.ascii_trim(texts, "\t\n\x0b\f\r "), *found]
        return pa.StructArray.from_arrays(found, names)

    def redact(texts: pa.Array) -> pa.Array:
        step = max(1, len(texts) * most // max(1, texts.nbytes))
        parts = [of_slice(texts.slice(at, step)) for at in range(0, max(1, len(texts)), step)]
        return pa.concat_arrays(parts)

    kinds = ["text string"] * text + [f"{field} long" for field in counters]
    return F.arrow_udf(redact, ", ".join(kinds))

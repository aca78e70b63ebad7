"""Language identification by compression.

Each language has a zstandard dictionary of raw text.  A text is compressed once with
each; the dictionary that gives the fewest bytes names the language.  Long texts are
compressed in pieces, or their own beginning would serve as the dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DICTIONARY_BYTES = 64 * 1024
ROWS_PER_LANGUAGE = 200
PIECE_CHARS = 1_000
NARROW = 0.01


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: dict[str, bytes]

    def identifier(self, narrow: float = NARROW, level: int = 7):
        """Column function from a text to ``struct<lang, score, accepted>``.

        ``lang`` is the language of the smallest output, ties to the first in
        alphabetical order; ``und`` if the text is null or has no letter, or nothing was
        learned.  ``score`` is the share by which the runner-up is larger, as a part of
        the largest; 1 if only one language is known, 0 for ``und``.  ``accepted`` is
        false where the score is below ``narrow``.
        """
        learned = sorted(self.dictionaries.items())

        @F.pandas_udf("lang string, score double, accepted boolean")
        def identify(texts: pd.Series) -> pd.DataFrame:
            tools = [
                (lang, zstandard.ZstdCompressor(
                    level=level, write_content_size=False, write_dict_id=False,
                    dict_data=zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT),
                ))
                for lang, raw in learned
            ]
            found = []
            for text in texts:
                if not text or not tools or not any(map(str.isalpha, text)):
                    found.append(("und", 0.0, False))
                    continue
                pieces = [
                    text[i : i + PIECE_CHARS].encode("utf-8", "replace")
                    for i in range(0, len(text), PIECE_CHARS)
                ]
                sizes = sorted(
                    (sum(len(tool.compress(p)) for p in pieces), lang) for lang, tool in tools
                )
                best = sizes[0]
                score = (sizes[1][0] - best[0]) / sizes[-1][0] if len(sizes) > 1 else 1.0
                found.append((best[1], score, score >= narrow))
            return pd.DataFrame(found, columns=["lang", "score", "accepted"])

        return identify


def train_languages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = ROWS_PER_LANGUAGE,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """A dictionary per value of ``lang`` from at most ``rows`` of its documents.

    Rows are taken in the order of a hash of id and text, long ones last, until the
    dictionary is full.  Rows that are alike in both count as one, null ids are told apart
    by their texts.  Null languages, null texts and texts without content are left out.
    What comes to the driver are less than twice ``dictionary_bytes`` for a language, in
    characters.
    """
    usable = docs.select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.lit(4), F.col(doc_id), F.col(text)).alias("hash"),
    ).where("lang IS NOT NULL AND length(text) > 0")
    # some four times as many as are needed, of rows of any number
    shares = usable.groupBy("lang").agg(
        F.least(F.lit(1.0), 4.0 * rows / F.approx_count_distinct("hash")).alias("share")
    )
    place = F.expr(f"(hash & {(1 << 30) - 1}) / {float(1 << 30)}D")
    # one row for each language, as the model has one dictionary for each
    some = usable.join(F.broadcast(shares), "lang").where(place < F.col("share"))
    each = some.groupBy("lang", "hash").agg(
        F.first(F.substring("text", 1, dictionary_bytes)).alias("text")
    )
    # texts that would fill much of a dictionary alone come last
    order = ["lang", F.length("text") > dictionary_bytes // 16, "hash"]
    first = Window.partitionBy("lang").orderBy(*order[1:])
    before = F.sum(F.length("text") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1))
    picked = each.select("*", F.row_number().over(first).alias("place"), before.alias("before"))
    picked = picked.where(
        (F.col("place") <= rows) & (F.coalesce("before", F.lit(0)) < dictionary_bytes)
    )
    found: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "place").select("lang", "text").collect():
        found.setdefault(row.lang, []).append(row.text.encode("utf-8", "replace"))
    # zstandard looks at the end of a dictionary first
    return LanguageModel({name: b"\n".join(t)[:dictionary_bytes] for name, t in found.items()})

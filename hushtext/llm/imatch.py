"""Document fingerprints in the manner of I-Match.

Only DataFrame functions are used.  Terms whose document frequency lies in a band
make up the lexicon; the lexicon is dealt out at random over several sub-lexicons.  A
fingerprint is one hash per sub-lexicon, over the sorted distinct terms of the text that
belong to it.

The lower end of the band is a share of all documents, so the lexicon cannot have more
than (mean distinct terms of a text) / share entries however large the corpus is; that
bound is why it may travel with the plan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUBSETS = 64
MIN_SHARE = 0.01
MAX_SHARE = 0.2
_LOWEST = -(2**63)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct lower-case words (letters and digits) of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    words = F.filter(F.array_distinct(words), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(
    docs: DataFrame,
    text: str = "text",
    min_share: float = MIN_SHARE,
    max_share: float = MAX_SHARE,
) -> list[int]:
    """Hashes of the terms found in ``min_share`` to ``max_share`` of all rows.

    A term of one document only is never taken.  Every row counts.
    """
    rows = docs.count()
    low, high = max(2, min_share * rows), max_share * rows
    counted = (
        docs.select(F.explode(term_hashes(F.col(text))).alias("term"))
        .groupBy("term")
        .count()
        .where(F.col("count").between(low, high))
    )
    return sorted(row.term for row in counted.select("term").collect())


def fingerprint(text: Column, terms: list[int], subsets: int = SUBSETS) -> Column:
    """Array of ``subsets`` hashes (32 bits); 0 where a sub-lexicon has no term.

    A text without any term of the lexicon is described by all its terms, so that
    short odd texts do not all look alike.  Null and empty texts give zeros only.
    """
    known_term = _member_of(terms)

    def in_lexicon(found: Column) -> Column:
        if not terms:
            return found
        known = F.filter(found, known_term)
        return _let(known, lambda k: F.when(F.size(k) > 0, k).otherwise(found))

    def one(own: Column) -> Column:
        hashed = F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.size(own) > 0, F.greatest(hashed, F.lit(1))).otherwise(0)

    def each(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(subsets - 1)),
            lambda subset: _let(
                F.filter(found, lambda t: F.pmod(t, F.lit(subsets)) == subset), one
            ),
        )

    return _let(_let(term_hashes(text), lambda f: F.array_sort(in_lexicon(f))), each)


def _member_of(terms: list[int]):
    """A test for a term, by a cuckoo hash table that is one constant array.

    A term lies at one of two places, so the test looks at two entries.
    """
    size = 8
    while size < 3 * len(terms):
        size *= 2
    while (slots := _placed(terms, size)) is None:
        size *= 2
    constant = F.from_json(F.lit(json.dumps(slots)), "array<bigint>")

    def test(term: Column) -> Column:
        first = term.bitwiseAND(F.lit(size - 1)).cast("int")
        second = F.shiftright(term, 32).bitwiseAND(F.lit(size - 1)).cast("int")
        return (F.get(constant, first) == term) | (F.get(constant, second) == term)

    return test


def _placed(terms: list[int], size: int) -> list[int | None] | None:
    """The table, or None if some term finds no place."""
    slots: list[int | None] = [None] * size
    for term in terms:
        at = term & (size - 1)
        for _ in range(500):
            slots[at], term = term, slots[at]
            if term is None:
                break
            homes = term & (size - 1), (term >> 32) & (size - 1)
            at = homes[1] if at == homes[0] else homes[0]
        else:
            return None
    return slots


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def as_text(hashes: Column) -> Column:
    """A fingerprint as hexadecimal digits, eight per sub-lexicon."""
    return F.array_join(
        F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sub-lexicons that either text has terms of.

    1 for equal fingerprints, those of two empty texts included.
    """

    def share(both: Column) -> Column:
        used = F.size(F.filter(both, lambda p: (p["x"] != 0) | (p["y"] != 0)))
        same = F.size(F.filter(both, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
        return F.when(used == 0, 1.0).otherwise(same / used)

    return _let(F.arrays_zip(a.alias("x"), b.alias("y")), share)


def with_next(docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Each row with ``next``: a struct of ``columns`` of the next row.

    Rows are in descending ``order``, nulls last, ties by ``columns``; after the last
    row comes the first.  No task sees all rows: the order is cut into ranges at
    quantiles, and the top row of each range is copied to the end of the range above.
    The number of ranges follows the number of rows.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_at", F.coalesce(F.col(order).cast("long"), F.lit(_LOWEST)))
    pieces = min(40_000, max(256, docs.count() // 5_000))
    points = [i / pieces for i in range(1, pieces)]
    bounds = rows.agg(
        F.percentile_approx("_at", F.array(*[F.lit(p) for p in points]), 4 * pieces)
    ).first()[0]
    piece = _range_of(F.col("_at"), sorted(set(bounds or [])))
    rows = rows.withColumn("_piece", piece)
    tops = rows.groupBy("_piece").agg(F.max("_at").alias("top")).orderBy("_piece")
    tops = [(r["_piece"], r["top"]) for r in tops.collect()]  # one row per range
    # the top row of a range also ends the range above; the very first row also ends
    # the lowest range
    copies = [(top, tops[i + 1][0], 0) for i, (_, top) in enumerate(tops[:-1])]
    copies += [(top, tops[0][0], 1) for _, top in tops[-1:]]
    ends = spark.createDataFrame(copies, "_at long, _into int, _wraps int")
    ends = ends.groupBy("_at").agg(
        F.collect_list(
            F.struct(F.col("_into").alias("piece"), F.col("_wraps").alias("wraps"), F.lit(1).alias("copy"))
        ).alias("_ends")
    )
    own = F.array(
        F.struct(F.col("_piece").alias("piece"), F.lit(0).alias("wraps"), F.lit(0).alias("copy"))
    )
    placed = (
        rows.join(F.broadcast(ends), "_at", "left")  # at most one row per range
        .withColumn("_ends", F.concat(own, F.coalesce("_ends", F.array_except(own, own))))
        .withColumn("_end", F.explode("_ends"))
        .drop("_ends", "_piece")
    )
    down = Window.partitionBy("_end.piece").orderBy(
        "_end.wraps", F.desc("_at"), *columns, "_end.copy"
    )
    return (
        placed.withColumn("next", F.lead(F.struct(*columns)).over(down))
        .where("_end.copy = 0")
        .drop("_at", "_end")
    )


def _range_of(at: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` lie below, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    fine = F.array(*[F.lit(b) for b in bounds])
    before = F.greatest(F.size(F.filter(coarse, lambda b: b < at)) - 1, F.lit(0)) * step
    near = F.slice(fine, before + 1, step)
    return (before + F.size(F.filter(near, lambda b: b < at))).cast("int")


def fingerprint_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likenesses.

    The edited text of a document has its last ``n_chars // 2`` code points replaced by
    as many first ones of the next document in descending id (after the last comes the
    first), or by all of that one if it is shorter.  A null text is empty.  Rows that
    repeat an id follow each other by text.  Columns: ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``.  Other columns of ``docs`` play no part.  An empty table gives an
    empty one.
    """
    texts = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    )
    terms = lexicon(texts)
    marked = texts.withColumn("marks", fingerprint(F.col("text"), terms))
    rows = with_next(marked, "doc_id", ["text", "marks"])
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), length - half),
        F.substring(F.col("next.text"), F.lit(1), half),
    )
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_marks", fingerprint(F.col("edited"), terms))
    return rows.select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next.marks")).alias("near_next"),
    )

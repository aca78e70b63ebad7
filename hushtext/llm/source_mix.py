"""Mixing sources to target weights.

Only DataFrame functions are used.  Token shares of the sources are raised to an
exponent between 0 (uniform) and 1 (as found).  The exponent is narrowed down until
the mix meets a target entropy or a repetition limit.  A token budget times the
normalised weight is the quota of a source: whole epochs over the source, then part of
one more epoch, taken as whole blocks of documents in a permuted order and at last part
of one block.

What is decided for a source is one row: its weight, its whole epochs, the permutation
key of the block where the quota ends, and how far into that block it goes.  So the
documents themselves are never shuffled, sorted or numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushtext.llm.common import saved

_POINTS = 64  # exponents tried at once
_ROUNDS = 4


@dataclass(frozen=True)
class MixTarget:
    """What the mix has to meet.

    ``entropy``: share (0 to 1) of the largest entropy the sources can have; the
    largest exponent that reaches it is taken.  ``max_repeats``: how often a source
    may be gone through; where both clash this limit wins.  ``budget``: tokens of the
    mix; ``None`` means as many as there are, ``"cover"`` as many as it takes for no
    document to be left out (a source is then gone through 1 to ``max_repeats`` times).
    """

    entropy: float | None = None
    max_repeats: float | None = None
    budget: int | str | None = None
    block_tokens: int = 200_000


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    target: MixTarget,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 0,
    prefix: str = "mix_",
) -> DataFrame:
    """All rows and columns of ``docs`` with what the mix does with each.

    Adds (names start with ``prefix``; a column of that name is replaced): ``tokens``,
    ``weight`` (of its source in the mix), ``copies`` (how often the document is in
    the mix, 0 if not) and ``slot`` (a number to sort the first epoch by: its blocks,
    permuted).  A null source is a source of its own.  Rows that repeat an id stand or
    fall together where a block is cut, so a quota can be missed by such a group; the
    share of a cut block is otherwise met to one document.  A document without tokens
    follows its block.  If no text has a token, every row has weight 0 and one copy.
    An empty table gives an empty one.
    """
    name = lambda field: f"{prefix}{field}"
    marked = docs.withColumns(
        {
            name("tokens"): count_tokens(F.col(text)),
            name("key"): _source_key(F.col(source)),
            name("hash"): F.xxhash64(F.lit(seed), F.col(doc_id)),
        }
    )
    slim = saved(
        marked.select(
            F.col(name("key")).alias("key"),
            F.col(name("tokens")).alias("tokens"),
            F.col(name("hash")).alias("hash"),
        ),
        "mix_tokens",
    )
    plan = _plan(slim, target, seed).select(*[F.col(c).alias(name(c)) for c in _PLAN])
    joined = marked.join(plan, name("key"), "left")
    block = _block(F.col(name("hash")), F.col(name("blocks")))
    slot = _block_key(F.col(name("key")), block, F.lit(0), seed)
    last = _block_key(F.col(name("key")), block, F.col(name("epochs")), seed)
    within = F.xxhash64(F.col(name("hash")), F.col(name("epochs")))
    extra = F.when(last < F.col(name("cut_key")), 1).when(
        (last == F.col(name("cut_key"))) & (within <= F.col(name("cut_hash"))), 1
    )
    copies = F.when(F.col(name("blocks")).isNull(), 1).otherwise(
        F.col(name("epochs")) + F.coalesce(extra, F.lit(0))
    )
    return joined.withColumns(
        {
            name("weight"): F.coalesce(name("weight"), F.lit(0.0)),
            name("copies"): copies.cast("int"),
            name("slot"): slot,
        }
    ).drop(*[name(c) for c in (*_PLAN, "hash") if c != "weight"])


_PLAN = ("key", "weight", "blocks", "epochs", "cut_key", "cut_hash")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _block(hash_: Column, blocks: Column) -> Column:
    return F.pmod(hash_, blocks)


def _block_key(key: Column, block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), key, block, epoch.cast("long"))


def _plan(slim: DataFrame, target: MixTarget, seed: int) -> DataFrame:
    """One row per source that has tokens."""
    totals = saved(
        slim.groupBy("key").agg(F.sum("tokens").alias("total")).where("total > 0"),
        "mix_totals",
    )
    all_tokens, sources = totals.agg(F.sum("total"), F.count("*")).first()
    all_tokens = float(all_tokens or 0)
    exponent = _exponent(totals, all_tokens, sources, target)
    raw = F.pow(F.col("total") / all_tokens, F.lit(exponent))
    norm, least = totals.agg(F.sum(raw), F.min(raw / F.col("total"))).first()
    if target.budget == "cover":
        budget = (norm or 1.0) / (least or 1.0)
    else:
        budget = float(all_tokens if target.budget is None else target.budget)
    # a hair of slack, or rounding would cut the last document of a whole epoch
    quota = F.lit(budget) * F.col("weight") * (1 + 1e-9)
    sized = (
        totals.withColumn("weight", raw / F.lit(norm or 1.0))
        .withColumn("epochs", F.floor(quota / F.col("total")))
        .withColumn("rest", quota - F.col("epochs") * F.col("total"))
        .withColumn(
            "blocks", F.ceil(F.col("total") / F.lit(target.block_tokens)).cast("long")
        )
    )
    # the block in which the last, partial epoch ends
    placed = slim.join(sized, "key").withColumn(
        "block", _block(F.col("hash"), F.col("blocks"))
    )
    in_order = Window.partitionBy("key").orderBy("block_key")
    ends = (
        placed.groupBy("key", "block", "epochs", "rest")
        .agg(F.sum("tokens").alias("size"))
        .withColumn("block_key", _block_key(F.col("key"), F.col("block"), F.col("epochs"), seed))
        .withColumn("upto", F.sum("size").over(in_order))
        .where("upto - size <= rest AND rest < upto")
        .select("key", "block", "block_key", (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))
    )
    in_block = Window.partitionBy("key").orderBy("within")
    cuts = (
        placed.join(ends, ["key", "block"])
        .withColumn("within", F.xxhash64("hash", "epochs"))
        .withColumn("upto", F.sum("tokens").over(in_block))
        .groupBy("key")
        .agg(
            F.first("block_key").alias("cut_key"),
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("within"))).alias("cut_hash"),
        )
    )
    return saved(sized.join(cuts, "key", "left").select(*_PLAN), "mix_plan")


def _exponent(totals, all_tokens, sources, target: MixTarget) -> float:
    """The exponent that meets the target, by repeated narrowing.

    Each round measures many exponents in one small aggregation; entropy and
    repetition both fall as the exponent grows.
    """
    if not sources:
        return 1.0

    def measured(points: list[float]) -> dict[float, tuple[float, float]]:
        rows = totals.withColumn("a", F.explode(F.array(*[F.lit(p) for p in points])))
        x = F.pow(F.col("total") / all_tokens, F.col("a"))
        share = x / F.col("total")
        budget = all_tokens if target.budget in (None, "cover") else float(target.budget)
        found = (
            rows.groupBy("a")
            .agg(
                F.sum(x).alias("z"), F.sum(x * F.log(x)).alias("s"),
                F.max(share).alias("most"), F.min(share).alias("least"),
            )
            .select(
                "a",
                (F.log("z") - F.col("s") / F.col("z")).alias("entropy"),
                (F.col("most") / F.col("least") if target.budget == "cover"
                 else F.lit(budget) * F.col("most") / F.col("z")).alias("repeats"),
            )
        )
        return {row.a: (row.entropy, row.repeats) for row in found.collect()}

    def narrowed(fits_low) -> tuple[float, float]:
        """Neighbours around the point where ``fits_low`` turns false."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            points = [low + (high - low) * i / _POINTS for i in range(_POINTS + 1)]
            values = measured(points)
            good = [p for p in points if fits_low(values[p])]
            if not good:
                return low, low
            if len(good) == len(points):
                return high, high
            low = good[-1]
            high = points[points.index(low) + 1]
        return low, high

    exponent = 1.0
    if target.entropy is not None:
        import math

        goal = target.entropy * math.log(sources) if sources > 1 else 0.0
        exponent = narrowed(lambda v: v[0] >= goal)[0]
    elif target.max_repeats is not None:
        exponent = 0.0
    if target.max_repeats is not None:
        limit = target.max_repeats
        exponent = max(exponent, narrowed(lambda v: v[1] > limit)[1])
    return exponent

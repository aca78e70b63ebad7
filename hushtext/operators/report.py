"""Counts per row and per table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hushtext.plans.fixed_values import COUNT_FIELDS, REPORT_LABELS

COUNTS = "redaction_counts"
TOTAL = "redactions_total"


def counts_struct(
    per_category: Mapping[str, Sequence[str]], counted: str | None = None
) -> Column:
    """Struct of the 17 counters, none null; passes of one category add up.

    ``per_category`` names the count columns of each category.  ``counted`` is a struct
    whose counters come first where they are not null.
    """
    fields = []
    for field, category in COUNT_FIELDS.items():
        tallies = [f"coalesce({name}, 0L)" for name in per_category.get(category, ())]
        number = " + ".join(tallies) or "0L"
        if counted and tallies:
            number = f"coalesce({counted}.{field}, {number})"
        fields.append(f"'{field}', {number}")
    return F.expr(f"named_struct({', '.join(fields)})")


def counts_total(counts: str = COUNTS) -> Column:
    """Sum of all counters of a counts struct."""
    return F.expr(" + ".join(f"{counts}.{field}" for field in COUNT_FIELDS))


def counts_json(counts: Column | str = COUNTS) -> Column:
    """The counters as pretty JSON, in field order."""
    return F.to_json(counts, {"pretty": "true"})


def _table_sums() -> list[Column]:
    zero = F.lit(0).cast("long")
    sums = [
        F.coalesce(F.sum(F.col(COUNTS)[field]), zero).alias(field)
        for field in COUNT_FIELDS
    ]
    return sums + [F.coalesce(F.sum(TOTAL), zero).alias(TOTAL)]


def redaction_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of a redacted table summed up by any keys.

    A hash aggregate with partial sums: what is shuffled is one row per key and
    input partition, so a key that holds most of the rows does no harm.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(TOTAL) > 0).alias("rows_redacted"),
        *_table_sums(),
    )


def redaction_report(df: DataFrame) -> DataFrame:
    """Long form of the table totals: ``ord, category, n``.

    The total comes first and is always there; then the categories with a count.
    """
    lines = [(0, "total", TOTAL)] + [
        (ord_, label, field)
        for ord_, (field, label) in enumerate(REPORT_LABELS.items(), start=1)
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(ord_).alias("ord"),
                F.lit(label).alias("category"),
                F.col(field).alias("n"),
            )
            for ord_, label, field in lines
        ]
    )
    return (
        df.agg(*_table_sums())
        .select(F.inline(entries))
        .where((F.col("n") > 0) | (F.col("ord") == 0))
        .orderBy("ord")
    )


def observe_redactions(
    df: DataFrame, observation: Observation | str = "redactions"
) -> DataFrame:
    """Attach the table totals to whatever action runs on ``df``.

    No second pass is needed.  Pass an ``Observation`` for batch and read it with
    ``.get`` after the action; pass a name for a stream and read the totals from
    its progress reports.  Attach it last, right before the write: a task of the
    writing stage is counted once even if it has to be run again.
    """
    return df.observe(
        observation, F.count(F.lit(1)).alias("rows"), *_table_sums()
    )


def format_report(totals: Mapping[str, int], as_json: bool = False) -> str:
    """Text or JSON form of observed totals, for a log or a terminal."""
    if as_json:
        return json.dumps({field: totals[field] for field in COUNT_FIELDS}, indent=2)
    width = max(map(len, REPORT_LABELS.values()))
    lines = [f"total redactions: {totals[TOTAL]}"]
    lines += [
        f"  {label:<{width}} {totals[field]}"
        for field, label in REPORT_LABELS.items()
        if totals[field] > 0
    ]
    return "\n".join(lines)

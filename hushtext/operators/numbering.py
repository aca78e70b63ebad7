"""Numbers in the order of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushtext.sources.scratch import written

_PART = "__hush_part"
_BEFORE = "__hush_before"


def numbered(df: DataFrame, by: str, name: str = "ord") -> DataFrame:
    """Add ``name``, the place of each row in the order of ``by``, from 1.

    The rows are dealt out by ranges of ``by``.  A row's number is its place within its
    range after the rows of all ranges before, of which only the counts meet in one task,
    one row for each range.  Values of ``by`` should be distinct; equal ones lie in one
    range, in any order.
    """
    dealt = df.repartitionByRange(by).withColumn(_PART, F.spark_partition_id())
    # which range a row is in is written once, as ranges are drawn from a sample
    placed = written(dealt, "ranges")
    counts = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0).cast("long"))
    counts = counts.select(_PART, before.alias(_BEFORE))
    within = F.row_number().over(Window.partitionBy(_PART).orderBy(by))
    return placed.join(counts, _PART).select(
        (F.col(_BEFORE) + within).alias(name), *df.columns
    )

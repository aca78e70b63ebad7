"""Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# texts differ in length by orders of magnitude, so small inputs are dealt out
# finely
_TASKS_PER_CORE = 4
# a task gets no more than this, so that its time does not grow with the table:
# all rules take some 15 s for that many short notes, or for the long texts of a
# compressed file of that size
_ROWS_PER_TASK = 25_000
_BYTES_PER_TASK = 4 << 20
# formats that know their number of rows without reading them
_COUNTED = ("parquet", "orc")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table of texts, spread over the whole cluster.

    The rules are bound by CPU, not by input size.  A table of a few files would
    keep a few cores busy, and a split of a columnar file may hold millions of rows
    or none, as row groups are not divided.  Such a table is dealt out evenly first,
    into more tasks the larger it is.  One with fine splits is read as it is: no
    shuffle.
    """
    scan = spark.read.format(fmt).load(path)
    return spread(scan, scan.count() if fmt in _COUNTED else None)


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal out a plain file scan that has too few partitions.

    They are too few if there are fewer than cores, or than its size on disk and
    ``rows``, where known, ask for.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(-(-size // _BYTES_PER_TASK), -(-(rows or 0) // _ROWS_PER_TASK))
    # planning a scan lists its files but runs no job
    if scan.rdd.getNumPartitions() >= max(cores, wanted):
        return scan
    return scan.repartition(max(cores * _TASKS_PER_CORE, wanted))


def write_redacted(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: tuple[str, ...] = (),
    text_col: str = "text",
    keep_text: bool = False,
) -> None:
    """Write a redacted table; what was there before is replaced.

    The original text, column ``text_col``, is left out unless ``keep_text`` is set.
    """
    if not keep_text:
        df = df.drop(text_col)
    df.write.mode(mode).partitionBy(*partition_by).format(fmt).save(path)

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from hushtext.sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what is read later does not depend on executors that
    may be lost, and is not computed again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``saved`` that nothing will read again."""
    for found in tables:
        spark = found.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(found.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Consecutive parts of about ``size`` bytes of texts or lists, one row at least.

    An empty column gives one empty part.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        yield column
        return
    if pa.types.is_list(column.type):
        sizes = pc.multiply(pc.list_value_length(column), 4)
    else:
        sizes = pc.binary_length(column)
    before = np.cumsum(pc.fill_null(sizes, 0).to_numpy(), dtype=np.int64)
    group = np.concatenate(([0], before[:-1])) // size
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for start, end in zip(starts, starts[1:], strict=False):
        yield column.slice(start, end - start)

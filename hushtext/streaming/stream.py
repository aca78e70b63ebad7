"""The same redaction on a stream."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hushtext.operators.redact import redact
from hushtext.operators.report import observe_redactions
from hushtext.plans.options import Options
from hushtext.sources.files import decoded, with_outcome


def redact_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    text_col: str = "text",
    *,
    safe_harbor: bool = False,
    skip: Collection[str] = (),
    config: Options | Mapping[str, Any] | None = None,
    fmt: str = "parquet",
    available_now: bool = False,
    every: str | None = None,
    observe: str | None = None,
    totals: str | None = None,
    keep_text: bool = False,
) -> StreamingQuery:
    """Redact a streaming DataFrame into files and return the running query.

    Each row is redacted on its own: no state, no watermark, append mode.
    ``checkpoint`` must lie on storage all executors share; together with the
    file sink it makes every row come out exactly once, also after a restart.
    ``observe`` names totals to report in the progress of each micro-batch.
    ``totals`` names a folder that keeps them for the whole run, also over restarts;
    ``stream_totals`` adds them up.  The rows then lie in one folder ``batch_id=N`` per
    micro-batch; a batch that is repeated replaces its rows and its totals, so each
    counts once.  Only this form takes dictionaries that are too long for a pattern.
    The original text is not written unless ``keep_text`` is set.
    """

    def redacted(rows: DataFrame) -> DataFrame:
        rows = redact(rows, text_col, safe_harbor=safe_harbor, skip=skip, config=config)
        return rows if keep_text else rows.drop(text_col)

    if totals:
        writer = stream.writeStream.foreachBatch(_with_totals(redacted, path, totals, fmt, observe))
    else:
        rows = redacted(stream)
        if observe:
            rows = observe_redactions(rows, observe)
        writer = rows.writeStream.format(fmt).outputMode("append").option("path", path)
    return _triggered(writer, checkpoint, available_now, every).start()


def redact_file_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    *,
    safe_harbor: bool = False,
    skip: Collection[str] = (),
    config: Options | Mapping[str, Any] | None = None,
    fmt: str = "parquet",
    recursive: bool = False,
    available_now: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Redact whole files as they arrive in the folder ``path``, each exactly once.

    The table at ``out`` is that of ``redact_files``: files that are not UTF-8 are rows
    of the partition ``outcome=quarantined``.  A stream gives no row for an empty file.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    rows = redact(decoded(files), safe_harbor=safe_harbor, skip=skip, config=config)
    writer = (
        with_outcome(rows)
        .writeStream.format(fmt)
        .outputMode("append")
        .partitionBy("outcome")
        .option("path", out)
    )
    return _triggered(writer, checkpoint, available_now, every).start()


def stream_totals(spark: SparkSession, totals: str) -> DataFrame:
    """``rows``, the counters and their total of all micro-batches, in one row."""
    kept = spark.read.parquet(totals)
    return kept.agg(*[F.sum(name).alias(name) for name in kept.columns if name != "batch_id"])


def _with_totals(redacted, path: str, totals: str, fmt: str, observe: str | None):
    """Write a micro-batch, then its totals, both under its number."""

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation(observe or "redactions")
        rows = observe_redactions(redacted(batch), seen)
        rows.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={number}")
        found = seen.get
        schema = ", ".join(f"`{name}` long" for name in found)
        line = batch.sparkSession.createDataFrame([tuple(found.values())], schema)
        line.coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch_id={number}")

    return write


def _triggered(
    writer: DataStreamWriter, checkpoint: str, available_now: bool, every: str | None
) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every) if every else writer

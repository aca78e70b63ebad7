"""Whole files as texts: one file is one document."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.operators.redact import redact
from hushtext.plans.options import Options
from hushtext.sources.text_files import write_texts

REDACTED = "redacted"
QUARANTINED = "quarantined"


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per file: ``path, length, valid_utf8, text``.

    ``text`` is null where the bytes are not UTF-8.  Line breaks are kept.  Files lie in
    ``path``, a file, folder or glob, and in its ``key=value`` folders; with
    ``recursive`` in all folders below.  An empty file has an empty text.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    files = scan.select("path", "length", "content")
    return decoded(files.unionByName(_empty_files(scan)))


def decoded(files: DataFrame) -> DataFrame:
    """``path, length, valid_utf8, text`` of ``path, length, content``."""
    content = F.col("content").cast("string")
    return (
        files.select("path", "length", content.alias("text"))
        .withColumn("valid_utf8", F.is_valid_utf8("text"))
        .select(
            "path",
            "length",
            "valid_utf8",
            F.when(F.col("valid_utf8"), F.col("text")).alias("text"),
        )
    )


def _empty_files(scan: DataFrame) -> DataFrame:
    """The files of ``scan`` without a byte, which Spark lists but does not read.

    They are the names in Spark's own listing, which is a job over the folders where
    these are many, less those that the scan gives.  No content is read for that, and
    the names go from the listing into a table together, not one by one.
    """
    spark = scan.sparkSession
    lines = spark._jvm.org.apache.hadoop.util.StringUtils
    names = lines.getStringCollection(lines.join("\n", scan._jdf.inputFiles()), "\n")
    strings = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    listed = DataFrame(spark._jsparkSession.createDataset(names, strings).toDF(), spark)
    # names in the listing are URIs, in which a plus stands for itself and an empty
    # authority may be written
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(plain, "^([^:/]+):///", "$1:/")
    return (
        listed.select(plain.alias("path"))
        .join(scan.select("path"), "path", "left_anti")
        .withColumns({"length": F.lit(0).cast("long"), "content": F.lit(b"")})
    )


def redact_files(
    spark: SparkSession,
    path: str,
    out: str,
    *,
    safe_harbor: bool = False,
    skip: Collection[str] = (),
    config: Options | Mapping[str, Any] | None = None,
    fmt: str = "parquet",
) -> None:
    """Redact whole files into a table at ``out``, in one pass.

    The table is partitioned by ``outcome``: ``redacted`` rows carry the text and
    its counts, ``quarantined`` rows are files that are not UTF-8, with neither.
    """
    rows = redact(read_files(spark, path), safe_harbor=safe_harbor, skip=skip, config=config)
    (
        with_outcome(rows)
        .write.mode("overwrite")
        .partitionBy("outcome")
        .format(fmt)
        .save(out)
    )


def with_outcome(rows: DataFrame) -> DataFrame:
    """Redacted files with their ``outcome`` in place of the raw text."""
    outcome = F.when(F.col("valid_utf8"), REDACTED).otherwise(QUARANTINED)
    return rows.withColumn("outcome", outcome).drop("text", "valid_utf8")


def redact_to_files(
    spark: SparkSession,
    path: str,
    out: str,
    *,
    safe_harbor: bool = False,
    skip: Collection[str] = (),
    config: Options | Mapping[str, Any] | None = None,
    recursive: bool = False,
    overwrite: bool = False,
) -> None:
    """Redact whole files into plain files of the same names below ``out``.

    Files that are not UTF-8 have no counterpart.
    """
    files = read_files(spark, path, recursive)
    rows = redact(files, safe_harbor=safe_harbor, skip=skip, config=config, counts=False)
    base = _base(spark, path)
    name = F.when(
        F.startswith("path", F.lit(base + "/")), F.substr("path", F.lit(len(base) + 2))
    ).otherwise(F.substring_index("path", "/", -1))
    write_texts(rows.withColumn("name", name), out, "name", "redacted", overwrite=overwrite)


def _base(spark: SparkSession, path: str) -> str:
    """The folder that names are relative to, as Spark writes it."""
    fixed = re.split(r"[*?\[{]", path)[0]
    folder = path if fixed == path else fixed.rpartition("/")[0] or "/"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(hadoop).toString().rstrip("/")

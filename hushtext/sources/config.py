"""Options from a JSON file."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hushtext.plans.options import FIELDS, Options


def load_options(spark: SparkSession, path: str | None = None) -> Options:
    """Read options from one JSON object; without a path, the defaults.

    All fields are optional: ``names``, ``keywords``, ``mrn_min_length``,
    ``mrn_max_length``.  Others are ignored.  Text that is not UTF-8, not JSON or
    holds a wrong type is an error.  The file may lie on any storage Spark reads.
    """
    if path is None:
        return Options()
    file = spark.read.format("binaryFile").load(path)
    if len(file.select("length").take(2)) != 1:
        raise ValueError(f"{path} is not a single file")
    raw = bytes(file.select(F.col("content")).first().content)
    return parse_options(raw.decode("utf-8"))


def parse_options(text: str) -> Options:
    """Options from JSON text."""
    values = json.loads(
        text, object_pairs_hook=_unique_fields, parse_constant=_no_constant
    )
    if not isinstance(values, dict):
        raise ValueError("options must be a JSON object")
    return Options.from_mapping(values)


def _unique_fields(pairs: list[tuple[str, object]]) -> dict[str, object]:
    known = [name for name, _ in pairs if name in FIELDS]
    if len(known) > len(set(known)):
        raise ValueError("an option is given twice")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")

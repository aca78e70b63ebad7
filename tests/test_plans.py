"""What the plans look like, and that they do not depend on the partitioning."""

import json
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import hushtext as ht


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_one_narrow_stage(documents):
    plan = plan_of(ht.redact(documents, safe_harbor=True))
    assert "Exchange" not in plan and "Sort" not in plan
    # one step in Python, for NFKC; the rest is generated code
    assert plan.count("ArrowEvalPython") == 1
    assert all("*(" in line for line in plan.splitlines() if "Project [" in line)


@pytest.mark.parametrize("safe_harbor", [False, True])
def test_generated_methods_are_small_enough_to_be_compiled(
    spark, documents, capsys, safe_harbor
):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or no code is shown
    try:
        ht.redact(documents, safe_harbor=safe_harbor).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    # the JVM only interprets longer ones
    assert sizes and all(int(size) <= 8000 for size in sizes)


def test_only_needed_columns_are_read(documents):
    rows = ht.redaction_summary(ht.redact(documents), ["lang"])
    assert "ReadSchema: struct<text:string,lang:string>" in plan_of(rows)


def test_filters_reach_the_scan(documents):
    rows = ht.redact(documents).where(F.col("lang") == "de")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan_of(rows)


def test_filters_on_results_stay_above_the_rules(documents):
    rows = ht.redact(documents, safe_harbor=True)
    hits = rows.where("redactions_total > 0 and redacted like '%[EMAIL]%'")
    assert plan_of(hits).count("[MRN]") <= plan_of(rows).count("[MRN]")
    wanted = rows.where("redacted like '%[EMAIL]%'").agg(F.sum("redactions_total"))
    assert wanted.first()[0] > 0


def test_summary_shuffles_partial_sums_only(documents):
    plan = plan_of(ht.redaction_summary(ht.redact(documents), ["lang"]))
    assert plan.count("Exchange hashpartitioning(lang") == 1
    assert "partial_sum" in plan


def test_skipped_categories_are_not_planned(documents):
    plan = plan_of(ht.redact(documents, skip=["person", "email"]))
    assert "[PERSON]" not in plan and "[EMAIL]" not in plan and "[DATE]" in plan
    assert "[IP]" not in plan


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitioning_does_not_matter(documents, partitions):
    def rows(df):
        done = ht.redact(df, safe_harbor=True).drop("text", "n_chars")
        return sorted(done.collect(), key=lambda r: r.doc_id)

    assert rows(documents.repartition(partitions)) == rows(documents)


def test_stream_and_batch_agree(spark, documents, tmp_path):
    stream = (
        spark.readStream.schema(documents.schema)
        .option("pathGlobFilter", "documents.parquet")
        .parquet(SMALL)
    )
    query = ht.redact_stream(
        stream,
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
        safe_harbor=True,
        available_now=True,
        observe="redactions",
    )
    query.awaitTermination()
    # the raw text is not written
    batch = ht.redact(documents, safe_harbor=True).drop("text")
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.count() == batch.count() == 200
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()
    totals = json.loads(query.lastProgress.json)["observedMetrics"]["redactions"]
    assert totals["rows"] == 200
    # a restart with the same progress folder adds nothing
    again = ht.redact_stream(
        stream,
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
        safe_harbor=True,
        available_now=True,
    )
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200

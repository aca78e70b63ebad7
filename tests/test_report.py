import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import hushtext as ht
from hushtext.plans import fixed_values as fixed

TEXTS = [
    ("en", "Mail a@b.co or c@d.co today."),
    ("en", "Nothing to see."),
    ("de", "Dr. Harmon called 555-111-2222."),
    ("de", None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return ht.redact(spark.createDataFrame(TEXTS, "lang string, text string"))


def test_summary(rows):
    found = {r.lang: r.asDict() for r in ht.redaction_summary(rows, ["lang"]).collect()}
    assert found["en"]["emails"] == 2 and found["en"]["relative_dates"] == 1
    assert (found["en"]["rows"], found["en"]["rows_redacted"]) == (2, 1)
    assert found["de"]["persons"] == 1 and found["de"]["phones"] == 1
    assert found["de"]["redactions_total"] == 2
    total = ht.redaction_summary(rows).first()
    assert (total["rows"], total.redactions_total) == (4, 5)


def test_report_lists_what_was_found_and_relative_dates_last(rows):
    report = [(r.category, r.n) for r in ht.redaction_report(rows).collect()]
    assert report == [
        ("total", 5), ("emails", 2), ("phones", 1), ("persons", 1),
        ("relative dates", 1),
    ]


def test_report_of_nothing(spark):
    empty = ht.redact(spark.createDataFrame([], "text string"))
    assert [tuple(r) for r in ht.redaction_report(empty).collect()] == [(0, "total", 0)]
    assert ht.redaction_summary(empty).first().redactions_total == 0


def test_json_has_all_fields_in_order_without_the_total(rows):
    texts = [r[0] for r in rows.select(ht.counts_json()).collect()]
    assert list(json.loads(texts[0])) == list(fixed.COUNT_FIELDS)
    assert json.loads(texts[0])["emails"] == 2
    assert "\n" in texts[0]


def test_total_is_the_sum(rows):
    assert rows.where(ht.counts_total() != F.col("redactions_total")).count() == 0


def test_observed_with_the_write(rows, tmp_path):
    seen = Observation()
    ht.write_redacted(
        ht.observe_redactions(rows, seen).drop("text"), str(tmp_path / "out")
    )
    assert seen.get["rows"] == 4 and seen.get["emails"] == 2
    text = ht.format_report(seen.get)
    assert text.splitlines()[0] == "total redactions: 5"
    assert "relative dates" in text.splitlines()[-1] and "zip" not in text
    assert list(json.loads(ht.format_report(seen.get, as_json=True))) == list(
        fixed.COUNT_FIELDS
    )


def test_counts_without_text(spark, rows):
    texts = spark.createDataFrame(TEXTS, "lang string, text string")
    counted = ht.redact(texts, text=False)
    assert counted.columns == ["lang", "text", "redaction_counts", "redactions_total"]
    assert counted.exceptAll(rows.drop("redacted")).isEmpty()
    for form in (ht.redaction_summary, ht.redaction_report):
        assert form(counted).collect() == form(rows).collect()
        plan = form(counted)._jdf.queryExecution().optimizedPlan().toString()
        tidied = form(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "btrim" not in plan.lower() and "trim(" not in plan and len(plan) < len(tidied)
    with pytest.raises(ValueError, match="neither"):
        ht.redact(texts, text=False, counts=False)

import json
from unittest import mock

import pytest
from conftest import SMALL

from pyspark.sql import functions as F

import __spark_entry__
import hushtext as ht
from hushtext.sources.scratch import scratch_path


def test_options_from_json(spark, tmp_path):
    path = tmp_path / "options.json"
    path.write_text(
        json.dumps({"names": ["Meredith Grey"], "mrn_min_length": 5, "other": {}}),
        encoding="utf-8",
    )
    options = ht.load_options(spark, str(path))
    assert "Meredith Grey" in options.surnames
    assert (options.mrn_min_length, options.mrn_max_length) == (5, 10)
    defaults = ht.load_options(spark)
    assert (defaults.mrn_min_length, defaults.mrn_max_length) == (6, 10)
    assert (len(defaults.surnames), len(defaults.facility_terms)) == (83, 11)


@pytest.mark.parametrize(
    "text",
    [
        "", "[]", "{", "{} {}", "null", '{"names": null}', '{"names": "x"}',
        '{"names": [1]}', '{"names": [null]}', '{"mrn_min_length": -1}',
        '{"mrn_min_length": 0}', '{"mrn_max_length": 0}', '{"mrn_min_length": 5.0}',
        '{"mrn_min_length": "5"}', '{"mrn_min_length": true}',
        '{"mrn_min_length": 11}', '{"mrn_max_length": 5}', '{"x": NaN}',
        '{"names": [], "names": []}',
    ],
)
def test_bad_options(text):
    with pytest.raises(ValueError):
        ht.parse_options(text)


def test_null_lengths_are_defaults():
    options = ht.parse_options('{"mrn_min_length": null, "keywords": ["X"], "x": 1}')
    assert options.mrn_min_length == 6 and "X" in options.facility_terms


def test_missing_or_broken_file(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        ht.load_options(spark, str(tmp_path / "none.json"))
    (tmp_path / "latin.json").write_bytes(b'{"names": ["\xff"]}')
    with pytest.raises(UnicodeDecodeError):
        ht.load_options(spark, str(tmp_path / "latin.json"))


def test_files_are_whole_documents_and_bad_ones_are_kept_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("Mail a@b.co\r\nline 2 é\n".encode())
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe a@b.co")
    (tmp_path / "in/c.txt").write_bytes(b"")
    (tmp_path / "in/_SUCCESS").write_bytes(b"")
    out = str(tmp_path / "out")
    ht.redact_files(spark, str(tmp_path / "in"), out)
    rows = {r.path.rsplit("/")[-1]: r for r in spark.read.parquet(out).collect()}
    assert rows["a.txt"].redacted == "Mail [EMAIL]\r\nline 2 é"
    assert rows["a.txt"].outcome == "redacted"
    assert rows["b.txt"].outcome == "quarantined" and rows["b.txt"].redacted is None
    assert rows["b.txt"].redactions_total == 0
    assert len(rows) == 3
    assert (rows["c.txt"].redacted, rows["c.txt"].redactions_total) == ("", 0)
    assert rows["c.txt"].outcome == "redacted"


def test_tables_are_replaced(spark, tmp_path):
    for text in ("a@b.co", "nothing"):
        df = spark.createDataFrame([(text,)], "text string")
        ht.write_redacted(ht.redact(df), str(tmp_path / "t"))
    written = spark.read.parquet(str(tmp_path / "t"))
    assert written.first().redacted == "nothing" and "text" not in written.columns


def test_a_stream_leaves_out_the_text(spark, tmp_path):
    spark.createDataFrame([("a@b.co", 1)], "text string, k int").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("text string, k int").parquet(str(tmp_path / "s"))
    args = str(tmp_path / "o"), str(tmp_path / "c")
    ht.redact_stream(stream, *args, available_now=True).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "o"))
    assert written.first().redacted == "[EMAIL]" and "text" not in written.columns


def test_backticks_in_column_names(spark):
    df = spark.createDataFrame([("a@b.co", 1)], ["text", "odd`name"])
    assert ht.redact(df).first()["odd`name"] == 1


def test_small_tables_are_dealt_out_and_large_ones_left_alone(spark, tmp_path):
    small = ht.read_table(spark, f"{SMALL}/documents.parquet")
    assert small.rdd.getNumPartitions() == 32
    spark.range(0, 1000, 1, 20).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    if wide.rdd.getNumPartitions() >= 8:
        assert ht.spread(wide) is wide


def test_scratch_paths_follow_the_cluster_setting(tmp_path):
    cluster = mock.Mock()
    cluster.sparkContext.master = "spark://host"
    cluster.conf.get.return_value = "s3a://shared/dir/"
    assert scratch_path(cluster, "x").startswith("s3a://shared/dir/x-")
    assert scratch_path(cluster, "x") != scratch_path(cluster, "x")
    cluster.conf.get.return_value = None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(cluster, "x")


def test_the_streamed_query_takes_a_folder_of_files(spark, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    query = __spark_entry__.queries()["redact_stream"]
    found, whole = query(spark, str(tmp_path)), query(spark, SMALL)
    assert found.count() == documents.count()
    assert found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()


def test_tasks_do_not_grow_with_the_rows_of_a_table(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 300_000, 1, 8).write.parquet(path)  # short rows in eight files
    assert spark.read.parquet(path).rdd.getNumPartitions() == 8
    dealt = ht.read_table(spark, path)
    sizes = dealt.groupBy(F.spark_partition_id().alias("part")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 25_000
    assert dealt.count() == dealt.distinct().count() == 300_000


def test_tasks_do_not_grow_with_the_bytes_of_a_table(spark, tmp_path):
    path = str(tmp_path / "long")
    text = F.expr("array_join(transform(sequence(1, 400), x -> sha2(concat(id, x), 256)), '')")
    spark.range(0, 2_000, 1, 8).withColumn("text", text).write.parquet(path)  # 50 MB
    assert spark.read.parquet(path).rdd.getNumPartitions() == 8
    dealt = ht.read_table(spark, path)
    assert dealt.rdd.getNumPartitions() >= 12
    assert dealt.count() == dealt.distinct().count() == 2_000


def test_tasks_of_the_single_rules_do_not_grow_with_the_notes(spark, tmp_path):
    for name in ("documents", "conversations", "pages", "benchmark"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    orders = spark.range(0, 1_000_000, 1, 8).selectExpr(
        "id AS o_orderkey", "id % 1000 AS o_custkey", "date'2024-01-02' AS o_orderdate"
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    texts = __spark_entry__._input(spark, str(tmp_path), __spark_entry__.ALL_TEXTS)
    notes = texts.where("src = 'note'").select("a", F.spark_partition_id().alias("part"))
    sizes = notes.groupBy("part").count().agg(F.max("count"), F.sum("count")).first()
    # 31,250 in each of four tasks a core
    assert sizes[0] <= 26_000 and sizes[1] == 1_000_000

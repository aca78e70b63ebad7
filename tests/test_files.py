"""Whole files: listing, plain text out, streams of files and their totals."""

from pathlib import Path

import pytest
from conftest import SMALL

import hushtext as ht
from hushtext.sources.text_files import _parts


def put(folder: Path, files: dict[str, bytes]):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)


def names_and_texts(df, base):
    return {r.path.split(f"{base}/")[1]: r.text for r in df.collect()}


def held(folder: Path):
    """Contents of all files below a folder that Hadoop does not take for hidden."""
    return {
        str(p.relative_to(folder)): p.read_bytes()
        for p in folder.rglob("*")
        if p.is_file() and not str(p.relative_to(folder)).startswith("_")
    }


def test_empty_files_in_partition_folders(spark, tmp_path):
    put(tmp_path / "in", {
        "day=1/site=a/x.txt": b"a@b.co", "day=1/site=a/empty.txt": b"",
        "day=2/site=b/only empty+é%41.txt": b"", "day=2/site=b/_hidden": b"",
    })
    found = names_and_texts(ht.read_files(spark, str(tmp_path / "in")), "in")
    assert found == {
        "day=1/site=a/x.txt": "a@b.co", "day=1/site=a/empty.txt": "",
        "day=2/site=b/only empty+é%41.txt": "",
    }


def test_recursive_globs_and_single_files(spark, tmp_path):
    put(tmp_path / "in", {"a/b/c.txt": b"", "a/d.txt": b"d", "e.txt": b""})
    base = str(tmp_path / "in")
    read = lambda path, **options: names_and_texts(ht.read_files(spark, path, **options), "in")
    assert read(base, recursive=True) == {"a/b/c.txt": "", "a/d.txt": "d", "e.txt": ""}
    assert read(f"{base}/e.txt") == {"e.txt": ""}
    assert read(f"{base}/a/*.txt") == {"a/d.txt": "d"}
    assert read(f"{base}/*/b") == {"a/b/c.txt": ""}


def test_names_of_files_do_not_pass_one_by_one(spark, tmp_path, monkeypatch):
    calls = []
    client = type(spark.sparkContext._gateway._gateway_client)
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.append(1), send(*a, **k))[1])
    used = {}
    for n in (3, 3, 300):
        put(tmp_path / f"in{n}", {f"{i}.txt": b"" for i in range(n)})
        calls.clear()
        files = ht.read_files(spark, str(tmp_path / f"in{n}"))
        used[n] = len(calls)
        assert files.count() == n
    assert used[300] < used[3] + 100


def test_files_to_files(spark, tmp_path):
    put(tmp_path / "in", {
        "a.txt": b"Mail a@b.co\r\nline 2", "sub/b.txt": "é 555-111-2222".encode(),
        "c.txt": b"", "bad.txt": b"\xff a@b.co",
    })
    out = tmp_path / "out"
    ht.redact_to_files(spark, str(tmp_path / "in"), str(out), recursive=True)
    assert held(out) == {
        "a.txt": b"Mail [EMAIL]\r\nline 2", "sub/b.txt": "é [PHONE]".encode(), "c.txt": b"",
    }
    assert (out / "_SUCCESS").exists()
    with pytest.raises(ValueError, match="not empty"):
        ht.redact_to_files(spark, str(tmp_path / "in"), str(out))
    ht.redact_to_files(spark, str(tmp_path / "in/a.txt"), str(out), overwrite=True)
    assert held(out) == {"a.txt": b"Mail [EMAIL]\r\nline 2"}
    ht.redact_to_files(spark, str(tmp_path / "in/*/b.*"), str(out), overwrite=True)
    assert held(out) == {"sub/b.txt": "é [PHONE]".encode()}


def test_whole_table_of_texts_as_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr(
        "concat('lang ', lang, '/', doc_id) as name", "text"
    )
    ht.write_texts(rows.repartition(7), str(tmp_path / "out"), "name", "text")
    wanted = {r.name: r.text.encode() for r in rows.collect() if r.text is not None}
    assert held(tmp_path / "out") == wanted


@pytest.mark.parametrize("bad", ["../x", "/x", "", "a//b", None])
def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path, bad):
    put(tmp_path / "out", {"old.txt": b"old"})
    rows = spark.createDataFrame([("a", "1"), (bad, "2"), ("c", None)], "name string, text string")
    with pytest.raises(Exception, match="not a name"):
        ht.write_texts(rows, str(tmp_path / "out"), "name", "text", overwrite=True)
    assert held(tmp_path / "out") == {"old.txt": b"old"}


def test_names_must_differ_and_nothing_is_a_result(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "name string, text string")
    with pytest.raises(ValueError, match="2 texts share the name 'a'"):
        ht.write_texts(rows, str(tmp_path / "out"), "name", "text")
    ht.write_texts(rows.where("false"), str(tmp_path / "none"), "name", "text")
    assert held(tmp_path / "none") == {} and (tmp_path / "none/_SUCCESS").exists()


def test_only_the_attempt_that_is_committed_counts(tmp_path):
    """A repeated task writes anew, a repeated move finds nothing left to do."""
    import pandas as pd
    import pyarrow as pa

    source, _, move_all = _parts()
    out, staging = tmp_path / "out", tmp_path / "out/_staging"
    staging.mkdir(parents=True)
    writer = source({"out": str(out), "staging": str(staging)}).writer(None, False)

    def lost():
        yield pa.RecordBatch.from_pydict({"name": ["x", "y"], "text": ["half", "a file"]})
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    batch = pa.RecordBatch.from_pydict({"name": ["x", "d/y"], "text": ["whole", "é\r\n"]})
    late = writer.write(iter([batch.slice(0, 1)]))  # a speculative twin, not committed
    done = writer.write(iter([batch]))
    assert late.folder != done.folder
    writer.commit([done, None])
    folders = (staging / "committed").read_text().split()
    assert folders == [done.folder]
    for _ in range(2):
        list(move_all([pd.DataFrame({"folder": folders})], str(out), str(out)))
    assert held(out) == {"x": b"whole", "d/y": "é\r\n".encode()}


def test_a_stream_of_files_goes_on_after_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, {"a.txt": b"Mail a@b.co", "b.txt": b"\xff\xfe"})

    def go():
        args = str(source), out, str(tmp_path / "progress")
        ht.redact_file_stream(spark, *args, available_now=True).awaitTermination()

    go()
    put(source, {"c.txt": "é 555-111-2222".encode(), "d.txt": b"\xc3"})
    go()
    go()
    streamed = spark.read.parquet(out)
    ht.redact_files(spark, str(source), str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch")).select(streamed.columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()
    assert streamed.where("outcome = 'quarantined'").count() == 2 and streamed.count() == 4


def test_totals_of_a_whole_stream(spark, tmp_path):
    """Restarts between batches, and a batch that is run again, change nothing."""
    source, out, totals = (str(tmp_path / n) for n in ("in", "out", "totals"))
    progress = tmp_path / "progress"
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    parts = documents.randomSplit([1.0, 1.0, 1.0], seed=1)

    def go(**options):
        stream = spark.readStream.schema(documents.schema).parquet(source)
        ht.redact_stream(
            stream, out, str(progress), totals=totals, available_now=True, **options
        ).awaitTermination()

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        go()
    # as after a failure between the write and the note that the batch is done
    last = max((p for p in (progress / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (progress / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    batch = ht.redact(documents)
    found = ht.stream_totals(spark, totals).first().asDict()
    wanted = ht.redaction_summary(batch).drop("rows_redacted").first().asDict()
    assert found == wanted and found["rows"] == documents.count()
    streamed = spark.read.parquet(out)
    assert streamed.select("batch_id").distinct().count() == 3
    assert streamed.drop("batch_id").exceptAll(batch.drop("text")).isEmpty()
    assert streamed.count() == documents.count()


def test_a_stream_with_totals_takes_long_dictionaries(spark, tmp_path):
    spark.createDataFrame([("Seen by Zorbax Quill.",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([("Zorbax Quill",)], "term string")
    config = ht.Options(names=names, literal_chars=1)
    ht.redact_stream(
        stream, str(tmp_path / "out"), str(tmp_path / "p"), config=config,
        totals=str(tmp_path / "t"), available_now=True,
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().redacted == "Seen by [PERSON]."

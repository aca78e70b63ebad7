"""Texts out, one plain file per document.

Each attempt of a task writes to a folder of its own below a staging folder.  The job
commits the folders of the attempts that Spark names as done and only these; a second
job then moves their files to their names, which may be repeated without harm.  So
failed, repeated and speculative attempts leave nothing behind, and a reader never
meets half a file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FORMAT = "hushtext_texts"
_NAME, _TEXT = "name", "text"
SUCCESS = "_SUCCESS"


def write_texts(
    df: DataFrame,
    out: str,
    name_col: str,
    text_col: str = "redacted",
    *,
    overwrite: bool = False,
) -> None:
    """Write each text, as UTF-8, to the file ``name_col`` below ``out``.

    Names are relative, may hold folders and must be distinct.  Rows with a null text
    are left out.  ``out`` must be new or empty unless ``overwrite`` is set, which
    replaces it whole, once all texts are written.  ``_SUCCESS`` is written last.
    Any file system that pyarrow knows will do.
    """
    spark = df.sparkSession
    rows = df.select(F.col(name_col).alias(_NAME), F.col(text_col).alias(_TEXT))
    rows = rows.where(F.col(_TEXT).isNotNull())
    twice = rows.groupBy(_NAME).count().where("count > 1").head()
    if twice:
        raise ValueError(f"{twice['count']} texts share the name {twice[_NAME]!r}")
    source, open_folder, move_all = _parts()
    store, root = open_folder(out)
    old = _children(store, root)
    if old and not overwrite:
        raise ValueError(f"{out} is not empty")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    store.create_dir(staging, recursive=True)
    spark.dataSource.register(source)
    writer = rows.write.format(_FORMAT).mode("append")
    try:
        writer.option("out", out).option("staging", staging).save()
    except BaseException:
        # a task that was being stopped may have written after the job's abort
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)
        raise
    for child in old:
        if child.is_file:
            store.delete_file(child.path)
        else:
            store.delete_dir(child.path)
    with store.open_input_stream(f"{staging}/committed") as file:
        folders = file.read().decode().split()
    if folders:
        moves = spark.createDataFrame([(f,) for f in folders], "folder string")
        moved = moves.repartition(len(folders), "folder").mapInPandas(
            lambda frames: move_all(frames, out, root), "moved long"
        )
        moved.agg(F.sum("moved")).collect()
    store.delete_dir(staging)
    with store.open_output_stream(f"{root}/{SUCCESS}"):
        pass


def _children(store, root: str) -> list:
    return store.get_file_info(fs.FileSelector(root, allow_not_found=True))


def _parts():
    """The data source, and two functions; all defined here so that they travel by value."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    def open_folder(path: str):
        from pyarrow import fs

        for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
            path = path.replace(hadoop, plain, 1) if path.startswith(hadoop) else path
        store, root = fs.FileSystem.from_uri(path)
        return store, root.rstrip("/")

    @dataclass
    class Written(WriterCommitMessage):
        folder: str
        files: int

    class TextWriter(DataSourceArrowWriter):
        def __init__(self, out, staging):
            self.out, self.staging = out, staging

        def write(self, iterator):
            import uuid

            store, _ = open_folder(self.out)
            folder, files, made = f"{self.staging}/{uuid.uuid4().hex}", 0, set()
            # fails, as it should, once the job has been given up
            store.create_dir(folder, recursive=False)
            for batch in iterator:
                for name, text in zip(batch.column(0), batch.column(1), strict=True):
                    name = name.as_py()
                    if not name or set(name.split("/")) & {"", ".", ".."}:
                        raise ValueError(f"not a name below the folder: {name!r}")
                    path = f"{folder}/{name}"
                    parent = path.rpartition("/")[0]
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    with store.open_output_stream(path, compression=None) as file:
                        file.write(text.as_buffer())
                    files += 1
            return Written(folder, files)

        def commit(self, messages):
            store, _ = open_folder(self.out)
            done = [m.folder for m in messages if m is not None and m.files]
            with store.open_output_stream(f"{self.staging}/committed") as file:
                file.write("\n".join(done).encode())

        def abort(self, messages):
            store, _ = open_folder(self.out)
            store.delete_dir(self.staging)

    class TextFiles(DataSource):
        @classmethod
        def name(cls):
            return _FORMAT

        def writer(self, schema, overwrite):
            return TextWriter(self.options["out"], self.options["staging"])

    def move_all(frames, out: str, root: str):
        import pandas as pd
        from pyarrow import fs

        store, _ = open_folder(out)
        for frame in frames:
            for folder in frame["folder"]:
                # a repeated task finds only what is still to be moved
                inside = fs.FileSelector(folder, recursive=True, allow_not_found=True)
                files = [f.path for f in store.get_file_info(inside) if f.is_file]
                made = set()
                for path in files:
                    target = root + path[len(folder) :]
                    parent = target.rpartition("/")[0]
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    store.move(path, target)
                yield pd.DataFrame({"moved": [len(files)]})

    return TextFiles, open_folder, move_all

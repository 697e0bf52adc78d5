"""A sink that writes one file for each row, under the name the row gives (S9).

    write_per_file(df, path, "output_filename", "text")

A task writes its rows into a folder of its own under ``path/_draft-...``; when all tasks are done the files
are moved to their names, else the folder goes and nothing is left.  So n rows give n files, a task that
is run again starts afresh, and a failed job leaves none.  Files of earlier jobs with the same names are replaced.
Two rows with one name are an error.  A name may hold folders, but no ``..``; null text is an empty file.
Paths may be local or of any store that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lexis.session import workers_find_package
from lexis.sources.slices import file_system


@dataclass
class TaskFiles(WriterCommitMessage):
    folder: str
    files: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> "NamedFilesWriter":
        return NamedFilesWriter(self.options["path"])


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.draft = f"{self.path}/_draft-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        task = TaskContext.get()
        store, folder = file_system(f"{self.draft}/{task.partitionId()}-{task.taskAttemptId()}")
        names: set[str] = set()
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = (name or "").split("/")
                if not all(parts) or ".." in parts or name in names:
                    raise ValueError(f"not a name for one file: {name!r}")
                names.add(name)
                store.create_dir("/".join([folder, *parts[:-1]]))
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
        return TaskFiles(folder, len(names))

    def commit(self, messages: list[TaskFiles | None]) -> None:
        from pyarrow import fs
        store, target = file_system(self.path)
        moved: set[str] = set()
        places = []
        for m in messages:  # one row a task; its files are listed from its folder
            if m is not None and m.files:
                found = store.get_file_info(fs.FileSelector(m.folder, recursive=True))
                places += [(f.path, f.path[len(m.folder) + 1:]) for f in found if f.type == fs.FileType.File]
        for _, name in places:
            if name in moved:
                self.abort(messages)
                raise ValueError(f"two rows have the name {name!r}")
            moved.add(name)
        for place, name in places:
            if "/" in name:
                store.create_dir(f"{target}/{name.rsplit('/', 1)[0]}")
            store.move(place, f"{target}/{name}")
        self.abort(messages)

    def abort(self, messages: list[TaskFiles | None]) -> None:
        from pyarrow import fs
        store, draft = file_system(self.draft)
        if store.get_file_info(draft).type == fs.FileType.Directory:
            store.delete_dir(draft)


def write_per_file(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """One file for each row, named by ``name_col``; text is UTF-8.  Rows are written where
    they are: no shuffle by name."""
    workers_find_package(df.sparkSession)
    df.sparkSession.dataSource.register(NamedFiles)
    (df.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
       .write.format("named_files").mode("append").save(path))

"""A sink for very many small text files: a task writes as many files as it is given, by name.

Spark's own writers make a folder and a part file for each value of a partition column. This one puts the
files of a task side by side into a folder of the task, and the driver only hears of these folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Reads like a partition column, so that Spark's readers find the files below.
PREFIX = "task="


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task, and how many files are in it."""

    folder: str
    files: int


def file_name(name: str | None) -> str:
    """A relative path for a name: slashes are kept, and no part of it can leave the folder."""
    parts = [quote(part, safe=" ,;=+@()[]~") for part in (name or "null").split("/") if part]
    return "/".join(part.replace(".", "%2E") if set(part) == {"."} else part for part in parts) or "_"


class FileWriter(DataSourceArrowWriter):
    """Rows (name, value) become files; the rows of a file come one after the other, in one task."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.job = uuid.uuid4().hex
        # Readers pass over names that begin so, and whatever a task that was given up writes stays in there.
        self.hidden = f"_writing-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        # Another attempt of the task gets a folder of its own, so two of them never write one file.
        folder = f"{PREFIX}{self.job}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        made, stream, current, files = set(), None, None, 0
        try:
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if stream is None or name != current:
                        if stream is not None:
                            stream.close()
                        path = f"{base}/{self.hidden}/{folder}/{file_name(name)}{self.suffix}"
                        if (parent := path.rpartition("/")[0]) not in made:
                            store.create_dir(parent)
                            made.add(parent)
                        stream, current, files = store.open_output_stream(path), name, files + 1
                    stream.write(value.encode())
        finally:
            if stream is not None:
                stream.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base)
        if self.overwrite:
            for entry in store.get_file_info(fs.FileSelector(base)):
                if entry.type == fs.FileType.Directory and entry.base_name.startswith(PREFIX):
                    store.delete_dir(entry.path)
        for message in messages:
            if message is not None and message.files:
                store.move(f"{base}/{self.hidden}/{message.folder}", f"{base}/{message.folder}")
        self._clean(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.path))

    def _clean(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.hidden}")


class NamedTextFiles(DataSource):
    """Data source ``named_text``; options ``path``, and ``suffix`` of the file names."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def write_text_files(rows: DataFrame, path: str, suffix: str = "", mode: str = "overwrite") -> None:
    """Writes rows (``name``, ``value``), which stand file by file within their partitions, to ``path``.

    A file's values follow each other without anything between them. Files appear when the job ends, by one rename a task, and
    with ``overwrite`` in place of those of earlier jobs; those of failed and repeated tasks never do. The folder must be
    on a store that pyarrow knows and that renames folders.
    """
    rows.sparkSession.dataSource.register(NamedTextFiles)
    rows.select("name", "value").write.format("named_text").mode(mode).option("suffix", suffix).save(path)

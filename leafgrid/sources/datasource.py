"""A Spark data source of document files: one row for each file, one file for each row.

Paths are plain ones, or URIs of any file system that Arrow reaches from the executors (``file:``,
``hdfs:``, ``s3:``, ``gs:``).  A writer needs one that can rename folders; plain paths must be mounted
by all executors.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    found, inside = FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else os.path.abspath(path))
    return found, inside.rstrip("/")


def _is(files: FileSystem, path: str, kind: FileType) -> bool:
    return files.get_file_info(path).type == kind


@dataclass
class _Files(InputPartition):
    names: list[str]


class DocumentFiles(DataSource):
    """``document_files``: options path, suffix (.pdf) and filesPerTask (64)."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "id string, content binary, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ".pdf"), int(options.get("filespertask", 64))

    def partitions(self) -> list[InputPartition]:
        files, top = file_system(self.path)
        found = files.get_file_info(FileSelector(top, recursive=True))
        names = sorted(x.path[len(top) :].lstrip("/") for x in found if x.type == FileType.File and x.path.endswith(self.suffix))
        return [_Files(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, top = file_system(self.path)
        for name in partition.names:
            stem = name[: -len(self.suffix)]
            with files.open_input_stream(f"{top}/{name}") as f:
                content = f.read()
            side = None
            if _is(files, f"{top}/{stem}.json", FileType.File):
                with files.open_input_stream(f"{top}/{stem}.json") as f:
                    side = f.read().decode()
            yield stem, content, side


class _Writer(DataSourceWriter):
    """Tasks write into a folder beside the target; the commit puts it in the target's place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.attempt = options["path"].rstrip("/"), options.get("suffix", ".pdf"), uuid.uuid4().hex
        files, top = file_system(self.path)
        if not overwrite and _is(files, top, FileType.Directory) and files.get_file_info(FileSelector(top)):
            raise FileExistsError(f"{self.path} already holds documents")

    def _places(self) -> tuple[FileSystem, str, str]:
        """The file system, the target and the folder beside it."""
        files, top = file_system(self.path)
        return files, top, f"{top}.{self.attempt}.part"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, _, staged = self._places()
        for row in rows:
            name = row["id"]
            if not name or posixpath.isabs(name) or ".." in name.split("/"):
                raise ValueError(f"no file name: {name!r}")  # an id must not lead out of the folder
            files.create_dir(posixpath.dirname(f"{staged}/{name}"), recursive=True)
            for suffix, value in ((self.suffix, row["content"]), (".json", row["json"] and row["json"].encode())):
                if value is not None:
                    # A repeated attempt of a task replaces its own files whole.
                    part = f"{staged}/{name}{suffix}.{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as f:
                        f.write(bytes(value))
                    files.move(part, f"{staged}/{name}{suffix}")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top, staged = self._places()
        files.create_dir(staged, recursive=True)
        old = f"{staged}.old"
        if _is(files, top, FileType.Directory):
            files.move(top, old)
        files.move(staged, top)
        if _is(files, old, FileType.Directory):
            files.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _, staged = self._places()
        if _is(files, staged, FileType.Directory):
            files.delete_dir(staged)

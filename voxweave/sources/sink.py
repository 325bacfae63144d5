"""A sink of files, one per row, that appear when the whole write is committed.

Tasks write below a hidden folder of their own attempt; the commit moves what the successful attempts wrote to its place, and
an abort removes the rest. So a task that is killed leaves nothing, one that is repeated or run twice at a time gives each file
once, and a failed job none. Paths are those of ``recordings.opened``; the folder must be one that all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from voxweave.sources.recordings import opened


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt wrote, and the names of its files."""

    at: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.ext = options["path"].rstrip("/"), options.get("ext", "")
        self.staging = f"{self.folder}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        at = f"{self.staging}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        system, place = opened(at)
        names: list[str] = []
        for source, body in iterator:
            if not names:
                system.create_dir(place, recursive=True)
            name = f"{source}{self.ext}"
            data = bytes(body) if isinstance(body, (bytes, bytearray)) else (json.dumps(json.loads(body), ensure_ascii=False, indent=2) if self.ext.endswith("json") else body).encode()
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(data)
            names.append(name)
        return Staged(place, names)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                to = f"{folder}/{name}"
                if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(to).is_file:
                    system.delete_file(to)
                system.move(f"{m.at}/{name}", to)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = opened(self.staging)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class Files(DataSource):
    """Rows (name, body: text or bytes) as files below path, each name followed by ext; JSON is indented."""

    @classmethod
    def name(cls) -> str:
        return "files_of_rows"

    def schema(self) -> str:
        return "source_id string, body string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite)

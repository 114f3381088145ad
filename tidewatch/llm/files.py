"""Files in the shared folder, written and read by Python workers.

``pyarrow.fs`` opens whatever store the folder's URI names. A file appears under its
name only when it is whole: it is written under a temporary name of this task attempt
and then renamed. Contents are deterministic, so a task that runs twice replaces a file
by an equal one.
"""

from __future__ import annotations

import contextlib
import hashlib
from typing import Self

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file under construction; ``commit`` gives it its name."""

    def __init__(self, folder: str, name: str):
        self.fs, path = locate(folder)
        self.fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        self.name, self.path = name, f"{path}/{name}"
        self.temporary = f"{path}/.{name}.tmp-{task.taskAttemptId() if task else 0}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size, self.sum = 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        """Append; returns where the data begins."""
        at = self.size
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        return at

    def commit(self) -> Self:
        self.out.close()
        with contextlib.suppress(FileNotFoundError, OSError):  # stores that don't rename over a file
            if self.fs.get_file_info(self.path).type != fs.FileType.NotFound and self.fs.type_name != "local":
                self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)
        return self

    def abort(self) -> None:
        self.out.close()
        with contextlib.suppress(FileNotFoundError, OSError):
            self.fs.delete_file(self.temporary)


def batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))

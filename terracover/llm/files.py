"""File access where tasks run: paths of any file system that pyarrow opens (file, hdfs, s3, gs)."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark import TaskContext


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class PartFile:
    """A part file of one task attempt; only names that the attempt returns are ever read.

    Bytes go to an attempt's own name, so retried and speculative attempts never share a file, and what
    a lost attempt has left is not listed in any manifest.
    """

    def __init__(self, folder: str, suffix: str):
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        self.path = f"{folder.rstrip('/')}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"
        system, name = resolve(self.path)
        system.create_dir(os.path.dirname(name), recursive=True)
        self.out = system.open_output_stream(name, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """The offset that the data was written to."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()

"""Archive files in the shared folder, opened from Python tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, suffix: str) -> str:
    """A name that no other task or attempt uses: files of attempts that failed are left out, not overwritten."""
    task = TaskContext.get()
    return f"{folder}/{stem}-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream to a new file; its folder is made if need be."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)

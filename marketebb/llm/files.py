"""Files that tasks write and read in the shared scratch folder, through the file systems of pyarrow.

A task writes under a name of its own attempt and reports it in its result rows; only rows of attempts that Spark commits
name a file, so a repeated or lost attempt leaves at most an unnamed file behind.
"""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def create(folder: str, stem: str, suffix: str) -> Iterator[tuple[str, pa.NativeFile]]:
    """(name, stream) of a new file in the folder; the file is taken away if the body fails."""
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    full = posixpath.join(path, name)
    try:
        with system.open_output_stream(full, compression=None, buffer_size=1 << 20) as out:
            yield name, out
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(full)
        raise


def open_file(folder: str, name: str) -> pa.NativeFile:
    """A seekable stream."""
    system, path = at(folder)
    return system.open_input_file(posixpath.join(path, name))


def delete(folder: str, name: str) -> None:
    system, path = at(folder)
    system.delete_file(posixpath.join(path, name))

"""Files in the shared folder, written and read by tasks through pyarrow's file systems.

A file appears under its name only when it is whole: it is written under another name and then moved, so a task that runs
again, or twice at a time, replaces it with an equal one.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _move(where: fs.FileSystem, source: str, target: str) -> None:
    try:
        where.move(source, target)
    except OSError:  # a store that doesn't move onto an existing file; what is there is equal
        where.delete_file(source)


@contextmanager
def creating(uri: str):
    """A stream whose file appears under uri at the end, if nothing is raised."""
    where, path = located(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    hidden = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    stream = where.open_output_stream(hidden, compression=None)
    try:
        yield stream
        stream.close()
    except BaseException:
        stream.close()
        where.delete_file(hidden)
        raise
    _move(where, hidden, path)


def reading(uri: str):
    """A sequential stream of the file's bytes as they are."""
    where, path = located(uri)
    return where.open_input_stream(path, compression=None)


def seekable(uri: str):
    where, path = located(uri)
    return where.open_input_file(path)


def exists(uri: str) -> bool:
    where, path = located(uri)
    return where.get_file_info(path).type != fs.FileType.NotFound


def write_table(uri: str, table: pa.Table) -> None:
    with creating(uri) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)


def read_table(uri: str) -> pa.Table:
    with seekable(uri) as f:
        return pa.ipc.open_file(f).read_all()

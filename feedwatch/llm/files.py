"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def put(folder: str, label: str, data: bytes) -> str:
    """Write ``data`` as a new file and return its name.

    Every attempt writes a name of its own, and a name counts only once the task's output rows, which
    carry it, are committed: retried and speculative tasks leave files that nobody refers to.
    """
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    name = f"{label}-{uuid.uuid4().hex}"
    with where.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def get(folder: str, name: str) -> bytes:
    where, path = _place(folder)
    with where.open_input_file(f"{path}/{name}") as source:
        return source.read()


def get_range(folder: str, name: str, start: int, size: int) -> bytes:
    where, path = _place(folder)
    with where.open_input_file(f"{path}/{name}") as source:
        return source.read_at(size, start)

"""Files on any file system that pyarrow reads: a path without a scheme is local."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, the path in it)"""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def absolute(path: str) -> str:
    return path.rstrip("/") if "://" in path or path.startswith("file:") else os.path.abspath(path)


def for_spark(path: str) -> str:
    """The path as a URI, so that Spark doesn't look for a local one on its default file system."""
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def read(path: str) -> bytes:
    system, name = opened(path)
    with system.open_input_stream(name, compression=None) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    """Replaces a file as one step, as far as its file system can."""
    system, name = opened(path)
    with system.open_output_stream(f"{name}.new", compression=None) as f:
        f.write(data)
    system.move(f"{name}.new", name)


def exists(path: str) -> bool:
    system, name = opened(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def remove(path: str) -> None:
    """A folder and all that is in it, if it is there."""
    system, name = opened(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)

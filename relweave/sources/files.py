"""Single files in whatever file system a path names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@contextmanager
def opened(path: str) -> Iterator:
    """A stream over a file, read as far as it is asked for."""
    fs, name = _at(path)
    with fs.open_input_stream(name, buffer_size=1 << 20) as f:
        yield f


@contextmanager
def created(path: str) -> Iterator:
    """A stream into a new file; its folders are made."""
    fs, name = _at(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name, buffer_size=1 << 20) as f:
        yield f


def write_bytes(path: str, data: bytes) -> None:
    """A small file."""
    with created(path) as f:
        f.write(data)


def read_bytes(path: str) -> bytes:
    """The whole of a small file."""
    with opened(path) as f:
        return f.read()


def text_file(df: DataFrame, path: str, line: Column) -> None:
    """One line for each row, row by row on the driver: for fixtures, whose names count."""
    with created(path) as f:
        for r in df.select(line.alias("line")).toLocalIterator():
            f.write((r.line + "\n").encode())

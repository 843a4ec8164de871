"""Evidence files by path, read in pieces where they lie."""

from __future__ import annotations

import io
from collections.abc import Callable
from fnmatch import fnmatchcase
from typing import BinaryIO
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))


def open_stream(path: str) -> BinaryIO:
    """A file that Spark lists under this path, as a stream; an error for stores that Arrow does not know."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    store, inside = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(inside)


def open_file(path: str) -> BinaryIO:
    """The same for reading at any place."""
    store, inside = _store(path)
    return store.open_input_file(inside)


def open_output(path: str) -> BinaryIO:
    """A new file, in the place of one of that name."""
    store, inside = _store(path)
    store.create_dir(inside.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inside)


def paths_of(path: str) -> list[tuple[str, int]]:
    """Path and length of every file that is, or lies below, a path, or that a pattern in its last part names."""
    store, inside = _store(path)
    folder, _, last = inside.rpartition("/")
    pattern = any(c in last for c in "*?[")
    info = store.get_file_info(folder if pattern else inside)
    if info.type == pyarrow.fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(pyarrow.fs.FileSelector(info.path, recursive=not pattern, allow_not_found=True))
    files = [f for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith(("_", ".")) and (not pattern or fnmatchcase(f.base_name, last))]
    return sorted((f.path if path == inside else path[: len(path) - len(inside.lstrip("/"))] + f.path.lstrip("/"), f.size) for f in files)


def _opens(path: str) -> bool:
    try:
        with open_stream(path) as source:
            source.read(1)
        return True
    except Exception:
        return False


def listed(spark: SparkSession, path: str, *, pattern: str | None = None) -> tuple[DataFrame, Callable[[str, bytes | None], BinaryIO]]:
    """``path``, ``content`` and ``length`` of every file that Spark's readers find, and what opens such a row, at any place.

    The content is null where tasks can open the path themselves, so that no row holds a file. In other
    stores a file is a row, and one over 2 GB an error.
    """
    reader = spark.read.format("binaryFile")
    if pattern is not None:  # files of such names below a folder
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    found = reader.load(path)
    first = found.select("path").first()
    if first is None or _opens(first.path):
        return found.select("path", F.lit(None).cast("binary").alias("content"), "length"), lambda name, _: open_file(name)
    return found.select("path", "content", "length"), lambda _, content: io.BytesIO(content)

"""Files in stores that pyarrow knows (local folders, HDFS, object stores), named by path or URI."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyarrow import fs


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a path, and the path's name there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def joined(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts)


def listed(path: str, suffix: str, deep: bool = False) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files under a folder, of one file, or of those that a pattern in the last part of the path takes, in order
    of names; only names with the suffix. A missing path is an error, as for Spark's readers."""
    where, name = place_of(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = where.get_file_info(name)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = where.get_file_info(fs.FileSelector(name, recursive=deep))
    else:
        folder, _, pattern = name.rpartition("/")
        if not set(pattern) & set("*?["):
            raise FileNotFoundError(f"no such file or folder: {path}")
        found = [x for x in where.get_file_info(fs.FileSelector(folder or ".", recursive=False)) if fnmatch.fnmatchcase(x.base_name, pattern)]
    uri = (lambda p: p) if not scheme else (lambda p: _uri(path, name, p))
    yield from sorted((uri(x.path), x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(suffix))


def _uri(path: str, name: str, found: str) -> str:
    """A found name as a URI like the path's, whose own name is `name`."""
    head = path[: len(path.rstrip("/")) - len(name.rstrip("/"))] if path.rstrip("/").endswith(name.rstrip("/")) else path[: path.index("://") + 3]
    return head + found


def opened(path: str):
    """An input file that can seek."""
    where, name = place_of(path)
    return where.open_input_file(name)


def size_of(path: str) -> int | None:
    """Bytes of a file; null if there is none."""
    where, name = place_of(path)
    info = where.get_file_info(name)
    return info.size if info.type == fs.FileType.File else None

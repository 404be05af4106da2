"""Files by name, on a mounted file system or any that Arrow opens by URI."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Entry:
    """One name of a directory, links not followed; times in nanoseconds."""

    path: str
    name: str
    kind: str  # file, directory, symlink, unreadable
    length: int | None
    changed: int


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it; a path without scheme is a mounted one."""
    if place.startswith("file:"):
        place = "/" + place.removeprefix("file:").lstrip("/")
    if "://" in place:
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), place


def _local(path: str, name: str) -> Entry:
    try:
        info = os.lstat(path)
    except OSError:
        return Entry(path, name, "unreadable", None, 0)
    kind = "symlink" if stat.S_ISLNK(info.st_mode) else "directory" if stat.S_ISDIR(info.st_mode) else "file"
    # a file that is moved into the tree keeps its modification time, not its change time
    return Entry(path, name, kind, info.st_size, info.st_ctime_ns)


def _remote(info: fs.FileInfo) -> Entry:
    kind = {fs.FileType.Directory: "directory", fs.FileType.File: "file"}.get(info.type, "unreadable")
    return Entry(info.path, info.base_name, kind, info.size if kind == "file" else None, info.mtime_ns or 0)


def look(system: fs.FileSystem, path: str) -> Entry:
    name = path.rstrip("/").rpartition("/")[2]
    if isinstance(system, fs.LocalFileSystem):
        return _local(path, name)
    return _remote(system.get_file_info(path))


def listed(system: fs.FileSystem, path: str, first: str = "", last: str | None = None) -> list[Entry]:
    """Names in a directory, from first to last, in order; none if it cannot be listed."""

    def within(name: str) -> bool:
        return first <= name and (last is None or name <= last)

    try:
        if isinstance(system, fs.LocalFileSystem):
            # names outside the range are not looked at
            found = [_local(os.path.join(path, n), n) for n in os.listdir(path) if within(n)]
        else:
            found = [_remote(i) for i in system.get_file_info(fs.FileSelector(path)) if within(i.base_name)]
    except OSError:
        return []
    return sorted(found, key=lambda e: e.name)


def directories(system: fs.FileSystem, root: str, excluded: frozenset[str]) -> Iterator[tuple[str, list[Entry]]]:
    """(directory, what it holds besides directories) below a root, excluded names not entered."""
    if look(system, root).name in excluded:
        return
    left = [root]
    while left:
        path = left.pop()
        entries = listed(system, path)
        yield path, [e for e in entries if e.kind != "directory"]
        left += [e.path for e in entries if e.kind == "directory" and e.name not in excluded]


def content(system: fs.FileSystem, path: str) -> bytes | None:
    try:
        with system.open_input_stream(path) as handle:
            return handle.read()
    except OSError:
        return None

"""Files on any file system that pyarrow knows, local paths included; folders of parts written by tasks."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    import os

    return pafs.LocalFileSystem(), os.path.abspath(path)


def prefix_of(path: str) -> str:
    """What makes a path within the file system a URI again."""
    fs, inner = resolve(path)
    return "" if isinstance(fs, pafs.LocalFileSystem) else path[: path.rindex(inner.lstrip("/"))].removesuffix("/") + "/"


def size_of(path: str) -> int:
    fs, inner = resolve(path)
    return fs.get_file_info(inner).size


def open_file(path: str) -> io.BufferedReader:
    fs, inner = resolve(path)
    return io.BufferedReader(fs.open_input_file(inner), 1 << 16)


def exists(path: str) -> bool:
    fs, inner = resolve(path)
    return fs.get_file_info(inner).type == pafs.FileType.File


def files_below(path: str, *suffixes: str) -> list[str]:
    """Data files at or below a path that every executor sees; names that begin with _ or . don't count, on any level."""
    fs, inner = resolve(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path.removeprefix("file://")]
    before = prefix_of(path)
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=True))
    names = [f.path for f in found if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(inner) :].strip("/").split("/"))]
    return sorted(before + (n.lstrip("/") if before else n) for n in names if not suffixes or n.endswith(suffixes))


class NewFolder:
    """A folder of parts: tasks write attempts beside each other, and only those that were counted become files.

    The folder must be absent or empty, as nothing that was there before is touched. What lost or
    repeated tasks leave behind lies among the attempts and goes with them.
    """

    def __init__(self, path: str):
        self.path = path
        fs, inner = resolve(path)
        if fs.get_file_info(inner).type == pafs.FileType.File or fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            raise FileExistsError(f"{path} is not an empty folder")
        fs.create_dir(f"{inner}/_attempts", recursive=True)

    def attempt(self, suffix: str) -> str:
        return f"part-{uuid.uuid4().hex}{suffix}"

    def create(self, name: str):
        fs, inner = resolve(self.path)
        return fs.open_output_stream(f"{inner}/_attempts/{name}", compression=None)

    def keep(self, names: Iterable[str]) -> None:
        self.keep_as({n: n for n in names})

    def keep_as(self, names: dict[str, str]) -> None:
        """Attempts become files of other names."""
        fs, inner = resolve(self.path)
        for attempt, name in names.items():
            fs.move(f"{inner}/_attempts/{attempt}", f"{inner}/{name}")
        self.close()

    def close(self) -> None:
        fs, inner = resolve(self.path)
        fs.delete_dir(f"{inner}/_attempts")

"""Files on any store that driver and executors share: listing and reading of byte ranges.

Paths are local paths or URIs (``file:``, ``s3:``, ``gs:``, ``hdfs:``); nothing is read on
the driver but directory listings, and no file has to fit into one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

#: Bytes of a file that one task reads at once, where its format can be split.
SPLIT = 64 << 20


def resolve(path: str):
    """(file system, path within it) of a local path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(path[5:].removeprefix("//"))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _full(path: str, inner: str) -> str:
    """A listed path as it can be opened again: a URI of the same kind, or a local path."""
    scheme, mark, _ = path.partition("://")
    return f"{scheme}://{quote(inner)}" if mark and scheme != "file" else inner


def list_files(path: str) -> list[tuple[str, int]] | None:
    """(path, bytes) of the file at a path or of all files under it; None if there is nothing."""
    from pyarrow import fs

    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return None
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return [(_full(path, f.path), f.size) for f in found if f.type == fs.FileType.File]


def discover_sized(paths: Sequence[str], extensions: Sequence[str] | None = None, skip_errors: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or under paths, sorted; extensions compare with letter case and
    without a dot, ``$MFT`` by the whole name. A path given twice gives its files twice."""
    out: list[tuple[str, int]] = []
    for p in paths:
        found = list_files(p)
        if found is None:
            if skip_errors:
                continue
            raise FileNotFoundError(p)
        for name, size in found:
            last = name.replace("\\", "/").rpartition("/")[2]
            if not extensions or last.rpartition(".")[2] in extensions and "." in last or (last == "$MFT" and "$MFT" in extensions):
                out.append((name, size))
    return sorted(out)


class Source:
    """A file opened for reading at any place."""

    def __init__(self, path: str):
        system, inner = resolve(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        if at >= self.size or n <= 0:
            return b""
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def lines(self, start: int, length: int, block: int = 1 << 20) -> Iterator[bytes]:
        """The lines that begin in a range, without their ends; only ``\\n`` ends a line."""
        at, end = start, min(start + length, self.size)
        rest = b""
        if start:  # the line that goes on from before belongs to the range before
            at = start - 1
            while at < self.size:
                piece = self.read(at, block)
                cut = piece.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(piece)
        while at < end:
            begin, pieces = at, []
            while True:
                cut = rest.find(b"\n")
                if cut >= 0:
                    pieces.append(rest[:cut])
                    rest = rest[cut + 1 :]
                    at = begin + sum(map(len, pieces)) + 1
                    break
                pieces.append(rest)
                rest = self.read(begin + sum(map(len, pieces)), block)
                if not rest:
                    at = self.size
                    break
            line = b"".join(pieces)
            yield line[:-1] if line.endswith(b"\r") else line

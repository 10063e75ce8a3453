"""Registry hives: cells of a hive file, with its transaction logs replayed, as one document per key."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

from tracequarry.sources import store

#: Fixed values of the format.
BASE = 4096
NONE, SZ, EXPAND_SZ, BINARY, DWORD, DWORD_BIG, LINK, MULTI_SZ, QWORD = 0, 1, 2, 3, 4, 5, 6, 7, 11
TYPE_NAMES = {
    NONE: "REG_NONE", SZ: "REG_SZ", EXPAND_SZ: "REG_EXPAND_SZ", BINARY: "REG_BINARY", DWORD: "REG_DWORD", DWORD_BIG: "REG_DWORD_BIG_ENDIAN", LINK: "REG_LINK",
    MULTI_SZ: "REG_MULTI_SZ", QWORD: "REG_QWORD",
}
LOG_SUFFIXES = (".LOG", ".LOG1", ".LOG2")
#: Largest number of bytes that a value keeps in one cell; larger ones are kept in pieces.
BIG_DATA = 16_344
_EPOCH = datetime(1601, 1, 1, tzinfo=UTC)


class Damaged(ValueError):
    """A hive, or a part of one, that cannot be read."""


def time_text(ft: int) -> str | None:
    try:
        return (_EPOCH + timedelta(microseconds=ft // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return None


def logs_of(path: str) -> list[str]:
    """The paths of a hive's transaction logs that exist."""
    return [p for s in LOG_SUFFIXES for p in (path + s, path + s.lower()) if store.list_files(p)]


def log_entries(data: bytes) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(sequence, [(offset in the bins, bytes)]) of a transaction log; a damaged entry ends it."""
    at = 512 if data[512:516] == b"HvLE" else BASE
    while data[at : at + 4] == b"HvLE" and at + 40 <= len(data):
        size, _, sequence, _, pages = struct.unpack_from("<IIIII", data, at + 4)
        if size < 40 or at + size > len(data) or 40 + 8 * pages > size:
            return
        body, out = at + 40 + 8 * pages, []
        for i in range(pages):
            offset, n = struct.unpack_from("<II", data, at + 40 + 8 * i)
            out.append((offset, data[body : body + n]))
            body += n
        yield sequence, out
        at += size


class Hive:
    """A hive in memory. ``logs`` are the contents of its transaction logs."""

    def __init__(self, data: bytes, logs: Sequence[bytes] = ()):
        if data[:4] != b"regf" or len(data) < BASE:
            raise Damaged("not a registry hive")
        first, second = struct.unpack_from("<II", data, 4)
        if logs:
            entries = sorted((e for log in logs for e in log_entries(log)), key=lambda e: e[0])
            newer = [e for e in entries if e[0] >= min(first, second)] if first != second else [e for e in entries if e[0] > first]
            if newer:
                changed = bytearray(data)
                for _, pages in newer:
                    for offset, page in pages:
                        end = BASE + offset + len(page)
                        if end > len(changed):
                            changed.extend(b"\0" * (end - len(changed)))
                        changed[BASE + offset : end] = page
                data = bytes(changed)
        self.data = data
        self.root = struct.unpack_from("<I", data, 0x24)[0]

    def cell(self, offset: int) -> bytes:
        at = BASE + offset
        if offset == 0xFFFFFFFF or at + 4 > len(self.data):
            raise Damaged("cell outside the hive")
        n = abs(struct.unpack_from("<i", self.data, at)[0])
        if n < 4 or at + n > len(self.data):
            raise Damaged("cell of impossible size")
        return self.data[at + 4 : at + n]

    def key(self, offset: int) -> Key:
        return Key(self, offset)

    def find(self, path: str) -> Key | None:
        """The key at a path under the root, names in any letter case."""
        key = self.key(self.root)
        for name in filter(None, path.split("\\")):
            key = next((k for k in key.subkeys() if k.name.lower() == name.lower()), None)
            if key is None:
                return None
        return key

    def walk(self) -> Iterator[tuple[str, Key | None, str | None]]:
        """(path, key, error) of all keys, parents first; paths leave the root's name out."""
        todo: list[tuple[str, int, bool]] = [("", self.root, True)]
        seen = set()
        while todo:
            above, offset, top = todo.pop()
            if offset in seen:
                continue
            seen.add(offset)
            try:
                key = self.key(offset)
                path = key.name if top else f"{above}\\{key.name}" if above else key.name
                below = [("" if top else path, o, False) for o in key.subkey_offsets()]
            except (Damaged, struct.error) as e:
                yield above, None, f"key under {above!r}: {e}"
                continue
            yield path, key, None
            todo += reversed(below)


class Key:
    """A key node."""

    def __init__(self, hive: Hive, offset: int):
        cell = hive.cell(offset)
        if cell[:2] != b"nk":
            raise Damaged("not a key")
        self.hive, self.cell = hive, cell
        flags = struct.unpack_from("<H", cell, 2)[0]
        self.written = struct.unpack_from("<Q", cell, 4)[0]
        size = struct.unpack_from("<H", cell, 72)[0]
        self.name = _name(cell[76 : 76 + size], bool(flags & 0x20))

    def subkey_offsets(self) -> list[int]:
        count, _, at = struct.unpack_from("<III", self.cell, 20)
        return _list(self.hive, at, 0) if count else []

    def subkeys(self) -> Iterator[Key]:
        for offset in self.subkey_offsets():
            try:
                yield self.hive.key(offset)
            except (Damaged, struct.error):
                continue

    def values(self) -> Iterator[tuple[str, int, bytes]]:
        """(name, type, bytes) of the readable values."""
        count, at = struct.unpack_from("<II", self.cell, 36)
        if not count:
            return
        offsets = self.hive.cell(at)
        for i in range(min(count, len(offsets) // 4)):
            try:
                yield _value(self.hive, struct.unpack_from("<I", offsets, 4 * i)[0])
            except (Damaged, struct.error):
                continue

    def value(self, name: str) -> tuple[int, bytes] | None:
        """(type, bytes) of the value of exactly this name."""
        return next(((t, d) for n, t, d in self.values() if n == name), None)


def _name(raw: bytes, single: bool) -> str:
    return raw.decode("cp1252", "replace") if single else raw.decode("utf-16-le", "replace")


def _list(hive: Hive, offset: int, depth: int) -> list[int]:
    """The key offsets of a subkey list, or of a list of lists."""
    cell = hive.cell(offset)
    kind, n = cell[:2], struct.unpack_from("<H", cell, 2)[0]
    if kind in (b"lf", b"lh"):
        return [struct.unpack_from("<I", cell, 4 + 8 * i)[0] for i in range(min(n, (len(cell) - 4) // 8))]
    if kind == b"li":
        return [struct.unpack_from("<I", cell, 4 + 4 * i)[0] for i in range(min(n, (len(cell) - 4) // 4))]
    if kind == b"ri" and depth < 8:
        return [o for i in range(min(n, (len(cell) - 4) // 4)) for o in _list(hive, struct.unpack_from("<I", cell, 4 + 4 * i)[0], depth + 1)]
    raise Damaged("unknown subkey list")


def _value(hive: Hive, offset: int) -> tuple[str, int, bytes]:
    cell = hive.cell(offset)
    if cell[:2] != b"vk":
        raise Damaged("not a value")
    length, size, at, kind, flags = struct.unpack_from("<HIIIH", cell, 2)
    name = _name(cell[20 : 20 + length], bool(flags & 1))
    if size & 0x80000000:
        return name, kind, struct.pack("<I", at)[: min(size & 0x7FFFFFFF, 4)]
    if not size:
        return name, kind, b""
    data = hive.cell(at)
    if data[:2] == b"db" and size > BIG_DATA:
        n, pieces = struct.unpack_from("<HI", data, 2)
        offsets = hive.cell(pieces)
        data = b"".join(hive.cell(struct.unpack_from("<I", offsets, 4 * i)[0])[:BIG_DATA] for i in range(n))
    return name, kind, data[:size]


def decoded(kind: int, data: bytes):
    """A value's data: text, integer, list of texts, hex of bytes, or None."""
    if kind in (SZ, EXPAND_SZ, LINK):
        return data.decode("utf-16-le", "replace").split("\0", 1)[0]
    if kind == DWORD and len(data) >= 4:
        return struct.unpack_from("<I", data)[0]
    if kind == DWORD_BIG and len(data) >= 4:
        return struct.unpack_from(">I", data)[0]
    if kind == QWORD and len(data) >= 8:
        return struct.unpack_from("<Q", data)[0]
    if kind == MULTI_SZ:
        return [x for x in data.decode("utf-16-le", "replace").split("\0") if x]
    if kind == NONE:
        return None
    return data.hex()


def key_document(path: str, key: Key) -> dict:
    """A key as key_name, key_path, last_modified, values (name, type, data) and subkeys (names)."""
    return {
        "key_name": key.name, "key_path": path, "last_modified": time_text(key.written),
        "values": [{"name": n, "type": TYPE_NAMES.get(t, "REG_BINARY"), "data": decoded(t, d)} for n, t, d in key.values()],
        "subkeys": [k.name for k in key.subkeys()],
    }


def open_hive(source: store.Source, logs: Sequence[str] = ()) -> Hive:
    contents = []
    for p in logs:
        with store.Source(p) as log:
            contents.append(log.read(0, log.size))
    return Hive(source.read(0, source.size), contents)


def documents(source: store.Source, logs: Sequence[str] = ()) -> Iterator[tuple]:
    """(record id, timestamp, JSON text, error) of every key."""
    from tracequarry.sources.files import compact

    try:
        hive = open_hive(source, logs)
    except (Damaged, struct.error) as e:
        yield None, None, None, str(e)
        return
    for path, key, error in hive.walk():
        if key is None:
            yield None, None, None, error
            continue
        try:
            doc = key_document(path, key)
        except (Damaged, struct.error) as e:
            yield None, None, None, f"key {path!r}: {e}"
            continue
        yield None, doc["last_modified"], compact(doc), None

"""Event-log files: chunks of 64 KiB with records of binary XML, decoded straight to JSON values.

A chunk holds everything its records refer to (names and templates by their offset in the
chunk), so chunks are decoded independently of each other. Templates are parsed once per
chunk to a tree with places for values; a record fills the tree in.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

#: Fixed values of the format.
FILE_MAGIC, CHUNK_MAGIC, RECORD_MAGIC = b"ElfFile\0", b"ElfChnk\0", 0x2A2A
HEADER, CHUNK, FIRST_RECORD = 4096, 65_536, 512
_EPOCH = datetime(1601, 1, 1, tzinfo=UTC)
_INTEGERS = {3: "<b", 4: "<B", 5: "<h", 6: "<H", 7: "<i", 8: "<I", 9: "<q", 10: "<Q"}
_WIDTHS = {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 11: 4, 12: 8, 13: 4, 15: 16, 17: 8, 18: 16, 20: 4, 21: 8}
#: Names under which rules look for values that are attributes.
ALIASES = {"Event.System.Provider": "Event.System.Provider_attributes.Name", "Event.System.TimeCreated": "Event.System.TimeCreated_attributes.SystemTime"}


class Damaged(ValueError):
    """A record or chunk that cannot be decoded."""


def filetime_text(ft: int) -> str | None:
    try:
        return (_EPOCH + timedelta(microseconds=ft // 10)).strftime("%Y-%m-%dT%H:%M:%S.%fZ") if ft else None
    except OverflowError:
        return None


def sid_text(data: bytes) -> str:
    """A security identifier with its authority in big-endian order."""
    if len(data) < 8:
        return ""
    count = min(data[1], (len(data) - 8) // 4)
    return "-".join(["S", str(data[0]), str(int.from_bytes(data[2:8], "big")), *(str(x) for x in struct.unpack_from(f"<{count}I", data, 8))])


def guid_text(data: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", data)
    return f"{a:08X}-{b:04X}-{c:04X}-{data[8:10].hex().upper()}-{data[10:16].hex().upper()}"


def scalar(kind: int, data: bytes):
    """The value of one typed item: text, integer, truth, or None."""
    if kind == 0 or (not data and kind not in (1, 2, 14)):
        return None
    if kind == 1:
        return data.decode("utf-16-le", "replace").split("\0", 1)[0]
    if kind == 2:
        return data.split(b"\0", 1)[0].decode("cp1252", "replace")
    if len(data) < _WIDTHS.get(kind, 0):
        raise Damaged("value too short")
    if kind in _INTEGERS:
        return struct.unpack_from(_INTEGERS[kind], data)[0]
    if kind in (11, 12):
        return struct.unpack_from("<f" if kind == 11 else "<d", data)[0]
    if kind == 13:
        return bool(data[0])
    if kind == 14:
        return data.hex()
    if kind == 15:
        return guid_text(data)
    if kind in (16, 20, 21):
        return f"0x{int.from_bytes(data[: 4 if kind == 20 else 8], 'little'):x}"
    if kind == 17:
        return filetime_text(struct.unpack_from("<Q", data)[0])
    if kind == 18:
        y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", data)
        return f"{y:04}-{mo:02}-{d:02}T{h:02}:{mi:02}:{s:02}.{ms:03}Z"
    if kind == 19:
        return sid_text(data)
    return None


def value(kind: int, data: bytes):
    """A typed value; arrays (kind with 0x80) as lists."""
    if not kind & 0x80:
        return scalar(kind, data)
    of = kind & 0x7F
    if of in (1, 2):
        parts = data.decode("utf-16-le" if of == 1 else "cp1252", "replace").split("\0")
        return parts[:-1] if parts and not parts[-1] else parts
    width = _WIDTHS.get(of)
    return [scalar(of, data[i : i + width]) for i in range(0, len(data) - width + 1, width)] if width else None


class _Slot:
    """A place in a template for a value; an optional one is left out when its value is null."""

    __slots__ = ("index",)

    def __init__(self, index: int):
        self.index = index


class _Element:
    __slots__ = ("name", "attributes", "content")

    def __init__(self, name: str):
        self.name, self.attributes, self.content = name, [], []


class Chunk:
    """One chunk with its names and templates."""

    def __init__(self, data: bytes):
        if data[:8] != CHUNK_MAGIC or len(data) < FIRST_RECORD:
            raise Damaged("not a chunk")
        self.data, self.end = data, min(struct.unpack_from("<I", data, 48)[0], len(data))
        self.names: dict[int, tuple[str, int]] = {}
        self.templates: dict[int, list] = {}

    def _name(self, offset: int) -> tuple[str, int]:
        """(name, bytes of its entry) at an offset of the chunk."""
        if offset not in self.names:
            if offset + 8 > len(self.data):
                raise Damaged("name outside the chunk")
            n = struct.unpack_from("<H", self.data, offset + 6)[0]
            self.names[offset] = self.data[offset + 8 : offset + 8 + 2 * n].decode("utf-16-le", "replace"), 10 + 2 * n
        return self.names[offset]

    def parse(self, at: int, end: int, values: list | None = None) -> list:
        """The content (elements, texts, slots) of the binary XML between two offsets of the chunk."""
        data = self.data
        top: list = []
        stack: list[_Element] = []
        attribute: list | None = None

        def put(x) -> None:
            (attribute if attribute is not None else stack[-1].content if stack else top).append(x)

        def name_at(at: int) -> tuple[str, int]:
            offset = struct.unpack_from("<I", data, at)[0]
            name, size = self._name(offset)
            return name, at + 4 + (size if offset == at + 4 else 0)

        try:
            while at < end:
                token, more = data[at] & 0x0F, data[at] & 0x40
                at += 1
                if token == 0x00:  # end of the fragment
                    break
                if token == 0x0F:
                    at += 3
                elif token == 0x01:
                    name, at = name_at(at + 6)
                    element = _Element(name)
                    put(element)
                    stack.append(element)
                    attribute = None
                    at += 4 if more else 0
                elif token == 0x02:
                    attribute = None
                elif token in (0x03, 0x04):
                    attribute = None
                    stack.pop()
                elif token == 0x06:
                    name, at = name_at(at)
                    attribute = []
                    stack[-1].attributes.append((name, attribute))
                elif token == 0x05:
                    kind, n = struct.unpack_from("<BH", data, at)
                    n = 2 * n if kind == 1 else n
                    put(value(kind, data[at + 3 : at + 3 + n]))
                    at += 3 + n
                elif token == 0x07 or token == 0x0B:
                    n = struct.unpack_from("<H", data, at)[0]
                    if token == 0x07:
                        put(data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"))
                    at += 2 + 2 * n
                elif token == 0x08:
                    put(chr(struct.unpack_from("<H", data, at)[0]))
                    at += 2
                elif token == 0x09:
                    name, at = name_at(at)
                    put({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(name, f"&{name};"))
                elif token == 0x0A:
                    _, at = name_at(at)
                elif token == 0x0C:
                    content, at = self._instance(at, end)
                    for x in content:
                        put(x)
                elif token in (0x0D, 0x0E):
                    put(_Slot(struct.unpack_from("<H", data, at)[0]))
                    at += 3
                else:
                    raise Damaged(f"unknown token {token:#x}")
        except (struct.error, IndexError) as e:
            raise Damaged(str(e)) from e
        return top

    def _instance(self, at: int, end: int) -> tuple[list, int]:
        """(content with its values filled in, offset behind it) of a template instance."""
        data = self.data
        offset = struct.unpack_from("<I", data, at + 5)[0]
        at += 9
        size = struct.unpack_from("<I", data, offset + 20)[0]
        if offset not in self.templates:
            self.templates[offset] = self.parse(offset + 24, min(offset + 24 + size, len(data)))
        if offset == at:
            at += 24 + size
        count = struct.unpack_from("<I", data, at)[0]
        if count > (end - at) // 4:
            raise Damaged("more values than there is room for")
        specs = [struct.unpack_from("<HB", data, at + 4 + 4 * i) for i in range(count)]
        at += 4 + 4 * count
        values = []
        for n, kind in specs:
            values.append(self.parse(at, at + n) if kind == 0x21 and n else value(kind, data[at : at + n]))
            at += n
        return _filled(self.templates[offset], values), at

    def records(self) -> Iterator[tuple[int | None, str | None, object, str | None]]:
        """(record id, time, value, error). What follows a damaged record in the chunk cannot be found."""
        at = FIRST_RECORD
        while at + 24 <= self.end:
            magic, size, number, written = struct.unpack_from("<IIQQ", self.data, at)
            if magic != RECORD_MAGIC:
                yield None, None, None, f"no record at offset {at} of the chunk"
                return
            if size < 28 or at + size > len(self.data):
                yield number, None, None, "record of impossible size"
                return
            try:
                content = self.parse(at + 24, at + size - 4)
                yield number, filetime_text(written), document(content), None
            except (Damaged, RecursionError) as e:
                yield number, filetime_text(written), None, f"record {number}: {e}"
            at += size


def _filled(content: list, values: list) -> list:
    out = []
    for x in content:
        if isinstance(x, _Slot):
            v = values[x.index] if x.index < len(values) else None
            out += v if isinstance(v, list) and v and isinstance(v[0], _Element) else [v]
        elif isinstance(x, _Element):
            e = _Element(x.name)
            e.attributes = [(n, _filled(c, values)) for n, c in x.attributes]
            e.content = _filled(x.content, values)
            out.append(e)
        else:
            out.append(x)
    return out


def _text(content: list) -> str:
    return "".join(str(x).lower() if isinstance(x, bool) else str(x) for x in content if x is not None and not isinstance(x, _Element))


def _simple(content: list):
    """The one value of content without elements: typed as stored, decimal text as an integer; None if empty."""
    filled = [x for x in content if x is not None and x != ""]
    if len(filled) == 1 and not isinstance(filled[0], str):
        return filled[0]
    text = _text(filled)
    if text.isascii() and text.isdigit() and (text == "0" or text[0] != "0") and len(text) < 19:
        return int(text)
    return text or None


def _add(out: dict, name: str, v) -> None:
    if name in out:
        out[name] = [*out[name], v] if isinstance(out[name], list) else [out[name], v]
    else:
        out[name] = v


def _data(element: _Element):
    """``EventData`` and ``UserData``: named values as members, unnamed ones under ``Data``; texts stay texts."""
    out: dict = {}
    for c in element.content:
        if not isinstance(c, _Element):
            continue
        name = next((_text(v) for n, v in c.attributes if n == "Name"), None) if c.name == "Data" else c.name
        inner = [x for x in c.content if isinstance(x, _Element)]
        filled = [x for x in c.content if x is not None]
        v = _data(c) if inner else filled[0] if len(filled) == 1 else (_text(filled) or None)
        if name is None:
            if v not in (None, ""):
                _add(out, "Data", v)
        else:
            _add(out, name, v)
    return out or None


def _members(element: _Element) -> dict:
    out: dict = {}
    for c in element.content:
        if not isinstance(c, _Element):
            continue
        attributes = {n: _simple(v) for n, v in c.attributes}
        attributes = {n: v for n, v in attributes.items() if v is not None}
        inner = any(isinstance(x, _Element) for x in c.content)
        v = _data(c) if c.name in ("EventData", "UserData") else _members(c) if inner else _simple(c.content)
        if attributes:
            _add(out, f"{c.name}_attributes", attributes)
        if v is not None or not attributes:
            _add(out, c.name, v)
    return out


def document(content: list):
    """Decoded content as a JSON value: members, with attributes beside them as ``Name_attributes``."""
    root = _Element("")
    root.content = content
    return _members(root) or None


def chunk_starts(size: int) -> range:
    """Offsets of a file's chunks."""
    return range(HEADER, max(HEADER, size - FIRST_RECORD + 1), CHUNK)

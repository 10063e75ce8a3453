"""ESE databases: tables of a database file as one document per row, with the table's name as ``Table``.

Pages are read one after the other, first for the catalogue and for values that are kept
apart, then for the rows, so that memory holds the catalogue and those values only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from tracequarry.sources import store

#: Fixed values of the format.
SIGNATURE = 0x89ABCDEF
CATALOGUE = 2
LEAF, SPACE_TREE, INDEX, LONG_VALUES = 0x2, 0x20, 0x40, 0x80
#: Bytes of column types that have a fixed size.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 4, 7: 8, 8: 8, 14: 4, 15: 8, 16: 16, 17: 2}
_FORMATS = {2: "<B", 3: "<h", 4: "<i", 5: "<q", 6: "<f", 7: "<d", 14: "<I", 15: "<q", 17: "<H"}
_OLE = datetime(1899, 12, 30, tzinfo=UTC)


class Damaged(ValueError):
    """A database that cannot be read."""


@dataclass
class Column:
    number: int
    name: str
    kind: int
    size: int
    code_page: int


@dataclass
class Table:
    name: str
    number: int
    columns: list[Column] = field(default_factory=list)
    long_values: int | None = None


def ole_text(days: float) -> str | None:
    """Days since 1899-12-30 as ISO text with seconds; None outside 1970 to 2500."""
    return (_OLE + timedelta(seconds=int(days * 86_400 + 0.5))).strftime("%Y-%m-%dT%H:%M:%SZ") if 25_569 <= days <= 219_146 else None


def seven_bit(data: bytes) -> bytes:
    """Bytes of seven-bit characters that were packed without gaps, lowest bits first."""
    value, out = int.from_bytes(data, "little"), bytearray()
    for i in range(len(data) * 8 // 7):
        out.append(value >> (7 * i) & 0x7F)
    return bytes(out)


def decompressed(data: bytes) -> bytes:
    """A value that may be packed: as seven-bit ASCII (1) or seven-bit UTF-16 (2); others stay as they are."""
    how = data[0] >> 3 if data else 0
    if how == 1:
        return seven_bit(data[1:]).rstrip(b"\0")
    if how == 2:
        return seven_bit(data[1:]).decode("latin-1").encode("utf-16-le")
    return data


def cell_value(column: Column, data: bytes):
    """A column's bytes as a JSON value; binary data as hex."""
    if column.kind in _FORMATS:
        return struct.unpack_from(_FORMATS[column.kind], data)[0] if len(data) >= SIZES[column.kind] else None
    if column.kind == 1:
        return bool(data[0]) if data else None
    if column.kind == 8:
        return ole_text(struct.unpack_from("<d", data)[0]) if len(data) >= 8 else None
    if column.kind == 16:
        if len(data) < 16:
            return None
        a, b, c = struct.unpack_from("<IHH", data)
        return f"{{{a:08x}-{b:04x}-{c:04x}-{data[8:10].hex()}-{data[10:16].hex()}}}"
    if column.kind in (10, 12):
        return data.decode("utf-16-le" if column.code_page == 1200 else "cp1252", "replace").rstrip("\0")
    return data.hex()


class Database:
    def __init__(self, source: store.Source):
        head = source.read(0, 668)
        if len(head) < 240 or struct.unpack_from("<I", head, 4)[0] != SIGNATURE:
            raise Damaged("not an ESE database")
        self.source = source
        self.page_size = struct.unpack_from("<I", head, 236)[0] or 4096
        self.revision = struct.unpack_from("<I", head, 232)[0]
        if self.page_size not in (2048, 4096, 8192, 16_384, 32_768):
            raise Damaged("impossible page size")
        self.large = self.page_size > 8192
        self.pages = max(0, source.size // self.page_size - 2)

    def page_entries(self, first: int = 1, last: int | None = None) -> Iterator[tuple[int, int, list[tuple[bytes, bytes]]]]:
        """(object, flags, [(key, data)]) of the leaf pages in a range of pages."""
        last = self.pages if last is None else min(last, self.pages)
        block = max(1, (4 << 20) // self.page_size)
        for begin in range(first, last + 1, block):
            n = min(block, last + 1 - begin)
            data = self.source.read((begin + 1) * self.page_size, n * self.page_size)
            for i in range(len(data) // self.page_size):
                page = data[i * self.page_size : (i + 1) * self.page_size]
                number, _, _, tags, flags = struct.unpack_from("<IHHHI", page, 24)
                if flags & LEAF and not flags & (SPACE_TREE | INDEX):
                    try:
                        yield number, flags, self._entries(page, tags)
                    except (struct.error, IndexError):
                        continue

    def _entries(self, page: bytes, tags: int) -> list[tuple[bytes, bytes]]:
        start = 80 if self.large and self.revision >= 0x11 else 40
        out, common = [], b""
        for i in range(tags):
            size, place = struct.unpack_from("<HH", page, self.page_size - 4 * (i + 1))
            if self.large:
                bits, size, place = 0, size & 0x7FFF, place & 0x7FFF
            else:
                bits, size, place = place >> 13, size & 0x1FFF, place & 0x1FFF
            value = bytearray(page[start + place : start + place + size])
            if i == 0:
                common = bytes(value)
                continue
            if self.large and len(value) >= 2:
                bits = value[1] >> 5
                value[1] &= 0x1F
            if bits & 0x2 or len(value) < 2:  # defunct
                continue
            at, shared = 0, 0
            if bits & 0x4:
                shared = struct.unpack_from("<H", value)[0]
                at = 2
            n = struct.unpack_from("<H", value, at)[0]
            out.append((common[:shared] + bytes(value[at + 2 : at + 2 + n]), bytes(value[at + 2 + n :])))
        return out

    def tables(self) -> dict[int, Table]:
        """The tables of the catalogue by their object number."""
        rows: list[tuple[int, int, int, int, int, int, str]] = []
        for number, flags, entries in self.page_entries():
            if number != CATALOGUE or flags & LONG_VALUES:
                continue
            for _, data in entries:
                if len(data) < 30:
                    continue
                last_variable, variable = data[1], struct.unpack_from("<H", data, 2)[0]
                table, kind, own, kind_or_page, size = struct.unpack_from("<IHIII", data, 4)
                pages_or_locale = struct.unpack_from("<I", data, 26)[0] if len(data) >= 30 else 0
                name = ""
                if last_variable >= 128 and variable + 2 <= len(data):
                    n = last_variable - 127
                    end = struct.unpack_from("<H", data, variable)[0]
                    name = data[variable + 2 * n : variable + 2 * n + (end & 0x7FFF)].decode("cp1252", "replace")
                rows.append((table, kind, own, kind_or_page, size, pages_or_locale, name))
        out = {table: Table(name, table) for table, kind, *_, name in rows if kind == 1}
        for table, kind, own, kind_or_page, size, locale, name in rows:
            if table in out and kind == 2:
                out[table].columns.append(Column(own, name, kind_or_page, size, locale))
            elif table in out and kind == 4:
                out[table].long_values = own
        for t in out.values():
            t.columns.sort(key=lambda c: c.number)
        return out

    def long_values(self, tables: dict[int, Table]) -> dict[tuple[int, bytes], bytes]:
        """Values kept apart from their rows, by (object of the tree, id)."""
        trees = {t.long_values for t in tables.values() if t.long_values is not None} | set(tables)
        pieces: dict[tuple[int, bytes], list[tuple[int, bytes]]] = {}
        for number, flags, entries in self.page_entries():
            if flags & LONG_VALUES and number in trees:
                for key, data in entries:
                    if len(key) >= 8:
                        pieces.setdefault((number, key[:4]), []).append((int.from_bytes(key[4:8], "big"), data))
        return {k: b"".join(d for _, d in sorted(v)) for k, v in pieces.items()}

    def row(self, table: Table, data: bytes, apart: dict[tuple[int, bytes], bytes]) -> dict:
        """A row's columns that have a value."""
        last_fixed, last_variable, variable = struct.unpack_from("<BBH", data)
        out: dict = {}
        at = 4
        fixed = [c for c in table.columns if c.number <= min(127, last_fixed)]
        nulls = data[variable - (last_fixed + 7) // 8 : variable]
        for c in fixed:
            size = SIZES.get(c.kind, c.size)
            i = c.number - 1
            if not (i // 8 < len(nulls) and nulls[i // 8] >> (i % 8) & 1):
                out[c.name] = cell_value(c, data[at : at + size])
            at += size
        count = max(0, last_variable - 127)
        ends = struct.unpack_from(f"<{count}H", data, variable)
        base, begin = variable + 2 * count, 0
        by_number = {c.number: c for c in table.columns}
        for k, end in enumerate(ends):
            here = end & 0x7FFF
            if not end & 0x8000 and 128 + k in by_number:
                out[by_number[128 + k].name] = cell_value(by_number[128 + k], data[base + begin : base + here])
            begin = here
        self._tagged(table, by_number, data[base + begin :], out, apart)
        return out

    def _tagged(self, table: Table, by_number: dict[int, Column], data: bytes, out: dict, apart: dict) -> None:
        if len(data) < 4:
            return
        mask = 0x7FFF if self.page_size >= 16_384 else 0x3FFF
        n = (struct.unpack_from("<H", data, 2)[0] & mask) // 4
        slots = [struct.unpack_from("<HH", data, 4 * i) for i in range(min(n, len(data) // 4))]
        for i, (number, offset) in enumerate(slots):
            begin = offset & mask
            end = slots[i + 1][1] & mask if i + 1 < len(slots) else len(data)
            value, bits = data[begin:end], 0
            if self.page_size >= 16_384 or offset & 0x4000:
                bits, value = (value[0] if value else 0), value[1:]
            column = by_number.get(number)
            if column is None:
                continue
            if bits & 0x4:  # kept apart: the id of the value
                value = apart.get((table.long_values, value[:4][::-1]), apart.get((table.number, value[:4][::-1]), b"")) if table.long_values is not None else apart.get((table.number, value[:4][::-1]), b"")
                if column.kind in (10, 12) and value and value[0] >> 3 in (1, 2):
                    value = decompressed(value)
            if bits & 0x2:
                value = decompressed(value)
            if bits & 0x8:  # several values
                k = (struct.unpack_from("<H", value)[0] & 0x7FFF) // 2 if len(value) >= 2 else 0
                ends = [struct.unpack_from("<H", value, 2 * j)[0] & 0x7FFF for j in range(k)] + [len(value)]
                out[column.name] = [cell_value(column, value[a:b]) for a, b in zip(ends, ends[1:])]
            else:
                out[column.name] = cell_value(column, value)

    def rows(self) -> Iterator[tuple[dict | None, str | None]]:
        """(row, error) of all tables, each with ``Table``."""
        tables = self.tables()
        apart = self.long_values(tables)
        for number, flags, entries in self.page_entries():
            table = tables.get(number)
            if table is None or flags & LONG_VALUES:
                continue
            for _, data in entries:
                try:
                    yield {**self.row(table, data, apart), "Table": table.name}, None
                except (struct.error, IndexError) as e:
                    yield None, f"row of {table.name}: {e}"


def documents(source: store.Source) -> Iterator[tuple]:
    """(record id, timestamp, JSON text, error) of every row; ids count rows from 0."""
    from tracequarry.sources.files import compact

    try:
        for n, (row, error) in enumerate(Database(source).rows()):
            yield n, None if row is None else row.get("TimeStamp"), None if row is None else compact(row), error
    except (Damaged, struct.error) as e:
        yield None, None, None, str(e)

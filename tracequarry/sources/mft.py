"""File-table entries from their binary form (fixed-size records with attributes)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

#: Fixed values of the format.
SIGNATURES = (b"FILE", b"BAAD")
STANDARD_INFORMATION, FILE_NAME, DATA, END = 0x10, 0x30, 0x80, 0xFFFFFFFF
SECTOR = 512
ROOT_ENTRY = 5
_EPOCH = datetime(1601, 1, 1, tzinfo=UTC)


def filetime_text(ft: int) -> str | None:
    """FILETIME as ISO text with seconds; None outside the years 1601 to 2500."""
    if not 0 < ft < 283_732_416_000_000_000:
        return None
    return (_EPOCH + timedelta(microseconds=ft // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _fix_up(record: bytearray) -> bool:
    """Puts back the two bytes at each sector's end; False when they do not fit."""
    at, count = struct.unpack_from("<HH", record, 4)
    if count < 1 or count - 1 > len(record) // SECTOR or at + 2 * count > len(record):
        return False
    mark = record[at : at + 2]
    for i in range(1, count):
        end = i * SECTOR
        if end > len(record):
            break
        if record[end - 2 : end] != mark:
            return False
        record[end - 2 : end] = record[at + 2 * i : at + 2 * i + 2]
    return True


def _names(bits: int, flags) -> str:
    return " | ".join(n for b, n in flags if bits & b) or "NONE"


def record_size(head: bytes) -> int:
    """The size of a table's entries, from its first one; 1,024 where that gives no usable size."""
    size = struct.unpack_from("<I", head, 28)[0] if len(head) >= 32 else 0
    return size if 512 <= size <= 4096 else 1024


def _entry(record: bytearray, index: int, resident_data: bool) -> tuple[dict, tuple[int, str] | None] | None:
    """(entry, (parent, name) or None) of one record; None when it cannot be read. A record
    marked as bad gives its head only."""
    from tracequarry.functions.forensic import ENTRY_FLAGS, FILE_FLAGS

    signature = bytes(record[:4])
    if signature not in SIGNATURES or (signature == SIGNATURES[0] and not _fix_up(record)):
        return None
    sequence, hard_links, first, flags, used, total = struct.unpack_from("<HHHHII", record, 0x10)
    base = struct.unpack_from("<Q", record, 0x20)[0]
    number = struct.unpack_from("<I", record, 0x2C)[0] if struct.unpack_from("<H", record, 4)[0] >= 0x30 else index
    entry: dict = {
        "Signature": signature.decode(), "EntryId": number, "Sequence": sequence, "BaseEntryId": base & 0xFFFFFFFFFFFF, "BaseEntrySequence": base >> 48,
        "HardLinkCount": hard_links, "Flags": _names(flags, ENTRY_FLAGS), "UsedEntrySize": used, "TotalEntrySize": total, "FileSize": 0,
        "IsADirectory": bool(flags & 2), "IsDeleted": not flags & 1, "HasAlternateDataStreams": False,
    }
    link = None
    if signature != SIGNATURES[0]:
        return entry, None
    best, p = -1, first
    while p + 16 <= len(record):
        kind, length = struct.unpack_from("<II", record, p)
        if kind == END or length < 16 or p + length > len(record):
            break
        outside, name_length = record[p + 8], record[p + 9]
        if not outside and length >= 24:
            size, offset = struct.unpack_from("<IH", record, p + 16)
            body = bytes(record[p + offset : p + offset + size])
        else:
            body = b""
        if kind == STANDARD_INFORMATION and len(body) >= 36:
            created, modified, _, accessed, bits = struct.unpack_from("<QQQQI", body)
            entry |= {"StandardInfoFlags": _names(bits, FILE_FLAGS), "StandardInfoLastModified": filetime_text(modified), "StandardInfoLastAccess": filetime_text(accessed), "StandardInfoCreated": filetime_text(created)}
        elif kind == FILE_NAME and len(body) >= 66:
            parent = struct.unpack_from("<Q", body)[0] & 0xFFFFFFFFFFFF
            created, modified, _, accessed = struct.unpack_from("<QQQQ", body, 8)
            real = struct.unpack_from("<Q", body, 48)[0]
            bits, space = struct.unpack_from("<I", body, 56)[0], body[65]
            name = body[66 : 66 + 2 * body[64]].decode("utf-16-le", "replace")
            rank = 0 if space == 2 else 1  # a short name only counts without a long one
            if rank > best:
                best = rank
                link = (parent, name)
                entry |= {"FileNameFlags": _names(bits, FILE_FLAGS), "FileNameLastModified": filetime_text(modified), "FileNameLastAccess": filetime_text(accessed), "FileNameCreated": filetime_text(created)}
                entry["FileSize"] = entry["FileSize"] or real
        elif kind == DATA:
            if name_length:
                entry["HasAlternateDataStreams"] = True
            elif outside and length >= 56:
                entry["FileSize"] = struct.unpack_from("<Q", record, p + 48)[0]
            else:
                entry["FileSize"] = len(body)
                if resident_data:
                    entry["ResidentData"] = body.hex()
        p += length
    return entry, link


def _records(read, size: int, start: int, length: int, resident_data: bool) -> Iterator[tuple[dict, tuple[int, str] | None]]:
    """Entries that begin in a range; ``read(at, n)`` gives bytes of a table of ``size`` bytes."""
    step = record_size(read(0, 32))
    at = -(-start // step) * step
    block = max(1, (1 << 20) // step) * step
    while at < min(start + length, size - step + 1):
        data = read(at, block)
        for p in range(0, len(data) - step + 1, step):
            if at + p >= start + length:
                break
            got = _entry(bytearray(data[p : p + step]), (at + p) // step, resident_data)
            if got:
                yield got
        at += block


def path_of(number: int, links: dict[int, tuple[int, str]]) -> str:
    """Names from the top to an entry, up to 256; the top is what hangs under the root, itself or nothing known."""
    parts, at, seen = [], number, set()
    while at in links and at not in seen and len(parts) < 256:
        seen.add(at)
        parent, name = links[at]
        parts.append(name)
        if parent in (at, ROOT_ENTRY):
            break
        at = parent
    return "\\".join(reversed(parts))


def entries(data: bytes, resident_data: bool = False) -> Iterator[dict]:
    """The readable entries of a file table, with full paths; damaged ones are skipped."""
    found = list(_records(lambda at, n: data[at : at + n], len(data), 0, len(data), resident_data))
    links = {e["EntryId"]: link for e, link in found if link}
    for e, _ in found:
        e["FullPath"] = path_of(e["EntryId"], links)
        yield e


def range_entries(source, start: int, length: int, resident_data: bool = False) -> Iterator[tuple[dict, tuple[int, str] | None]]:
    """(entry, link) of a range of a table; where it is the whole table, entries have their full paths."""
    head = source.read(0, 4)
    if head not in SIGNATURES:
        raise ValueError("not a file table")
    if start == 0 and length >= source.size:
        found = list(_records(source.read, source.size, 0, source.size, resident_data))
        links = {e["EntryId"]: link for e, link in found if link}
        for e, link in found:
            e["FullPath"] = path_of(e["EntryId"], links)
            yield e, link
    else:
        yield from _records(source.read, source.size, start, length, resident_data)

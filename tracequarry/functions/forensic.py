"""Scalar functions over forensic values, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.rules.compile import ascii_lower  # noqa: F401  (part of this module's functions)

#: 100 ns ticks from 1601 to 1970.
EPOCH_TICKS = 116_444_736_000_000_000
#: Flags of file-table entries and of files, by bit.
ENTRY_FLAGS = ((0x1, "ALLOCATED"), (0x2, "INDEX_PRESENT"))
FILE_FLAGS = (
    (0x1, "FILE_ATTRIBUTE_READONLY"), (0x2, "FILE_ATTRIBUTE_HIDDEN"), (0x4, "FILE_ATTRIBUTE_SYSTEM"), (0x20, "FILE_ATTRIBUTE_ARCHIVE"), (0x40, "FILE_ATTRIBUTE_DEVICE"),
    (0x80, "FILE_ATTRIBUTE_NORMAL"), (0x100, "FILE_ATTRIBUTE_TEMPORARY"), (0x200, "FILE_ATTRIBUTE_SPARSE_FILE"), (0x400, "FILE_ATTRIBUTE_REPARSE_POINT"),
    (0x800, "FILE_ATTRIBUTE_COMPRESSED"), (0x1000, "FILE_ATTRIBUTE_OFFLINE"), (0x2000, "FILE_ATTRIBUTE_NOT_CONTENT_INDEXED"), (0x4000, "FILE_ATTRIBUTE_ENCRYPTED"),
    (0x10000000, "FILE_ATTRIBUTE_DIRECTORY"),
)
#: Machine types of programs.
ARCHITECTURES = {34404: "AMD64", 452: "ARM", 332: "I386", 512: "IA64"}


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def filetime_micros(ft: Column) -> Column:
    """FILETIME as ISO text with microseconds; null for null, 0 and negative."""
    return F.when(ft > 0, rfc3339(F.timestamp_micros(F.floor((ft - EPOCH_TICKS).cast("decimal(20,0)") / 10).cast("bigint"))))


def filetime_seconds(ft: Column) -> Column:
    """FILETIME as ISO text with seconds; null outside the years 1601 to 2500."""
    seconds = F.floor((ft - EPOCH_TICKS).cast("decimal(20,0)") / 10_000_000).cast("bigint")
    return F.when((ft > 0) & (seconds < 16_756_761_600), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def ole_date(days: Column) -> Column:
    """Days since 1899-12-30 as ISO text with seconds; null outside 1970 to 2500."""
    return F.when((days >= 25_569) & (days <= 219_146), F.date_format(F.timestamp_seconds(F.floor((days - 25_569) * 86_400).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def format_duration(days: Column) -> Column:
    """``N days, H hours, M minutes`` without parts that are zero."""
    minutes = F.round(days * 1440).cast("bigint")
    d, h, m = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60
    return F.concat_ws(", ", *[F.when(x > 0, F.concat(x.cast("string"), F.lit(f" {n}"))) for x, n in ((d, "days"), (h, "hours"), (m, "minutes"))])


#: Seconds of a period and entries kept, without and with long term, where nothing else is set.
RETENTION = {"Tier2": (3600.0, 1440.0), "Tier2LongTerm": (604_800.0, 260.0)}


def retention_days(extension: tuple[Column, Column], parameters: tuple[Column, Column], tier: str = "Tier2") -> Column:
    """Days that a table's records are kept: (period, entries) of the table's own settings, else of the
    common parameters, else the defaults."""
    period, entries = (F.coalesce(e.try_cast("double"), p.try_cast("double"), F.lit(d)) for e, p, d in zip(extension, parameters, RETENTION[tier]))
    return period * entries / 3600 / 24


def hex_version(text: Column) -> Column:
    """Sixteen hex digits as ``a.b.c.d``; any other text as it stands."""
    parts = [F.conv(F.substring(text, 1 + 4 * i, 4), 16, 10) for i in range(4)]
    return F.when(text.rlike("^[0-9A-Fa-f]{16}$"), F.concat_ws(".", *parts)).otherwise(text)


def architecture(machine: Column) -> Column:
    out = F.concat(F.lit("Unknown ("), machine.cast("string"), F.lit(")"))
    for k, v in ARCHITECTURES.items():
        out = F.when(machine == k, v).otherwise(out)
    return out


def flag_names(bits: Column, flags=FILE_FLAGS) -> Column:
    """Names of the set bits joined by `` | ``; ``NONE`` without any; null for null."""
    names = F.concat_ws(" | ", *[F.when(bits.cast("bigint").bitwiseAND(F.lit(b).cast("bigint")) != 0, n) for b, n in flags])
    return F.when(bits.isNotNull(), F.when(names == "", F.lit("NONE")).otherwise(names))


def sha1_of_file_id(file_id: Column) -> Column:
    """A file id of 44 digits without its four leading zeros; else null."""
    return F.when((F.length(file_id) == 44) & file_id.startswith("0000"), F.substring(file_id, 5, 40))


def clean_path(path: Column) -> Column:
    """Without ``\\??\\``, and with ``SYSVOL\\`` as ``C:\\``."""
    bare = F.regexp_replace(path, r"^\\\?\?\\", "")
    return F.regexp_replace(bare, r"^SYSVOL\\", r"C:\\")


def last_path_part(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"[^/]+$", 0)


def is_program_entry(text: Column) -> Column:
    return (F.length(text) >= 50) & text.rlike(r"^[0-9A-Fa-f]{8}\b") & (F.size(F.split(F.trim(text), r"\s+")) >= 6)


def program_fields(text: Column) -> dict[str, Column]:
    """The fields of a program's cache entry; null for entries that are none."""
    parts = F.split(F.trim(text), r"\s+")
    entry = is_program_entry(text)
    field = lambda i: F.when(entry, F.get(parts, F.lit(i)))
    machine = F.when(F.length(field(3)) == 4, F.conv(field(3), 16, 10).try_cast("int"))
    return {
        "program_version": hex_version(field(1)), "sdk_version": hex_version(field(2)), "architecture": F.when(machine.isNotNull(), architecture(machine)),
        "program_name": field(4), "publisher_id": field(5), "neutral": F.when(F.get(parts, F.lit(6)).isNotNull() & entry, field(6) == "neutral"),
    }


def bytes_to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def utf16_text(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def size_text(n: Column) -> Column:
    """A number of bytes in the largest unit that leaves at least one, with two decimals above bytes (halves to even)."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.2f", F.bround(n / float(1024**k), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def record_key(source: Column, record_id: Column) -> Column:
    """The same id for the same document in every run."""
    return F.sha2(F.concat_ws("\0", source, F.coalesce(record_id.cast("string"), F.lit(""))), 256)


def sid_text(data: Column) -> Column:
    """A binary security identifier as ``S-rev-authority-sub-…``; null when too short."""
    h = F.hex(data)
    authority = F.conv(F.substring(h, 5, 12), 16, 10)
    count = F.floor((F.length(h) - 16) / 8).cast("int")
    subs = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.conv(F.concat(*[F.substr(h, 17 + 8 * i + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10))
    return F.when(F.length(data) > 8, F.concat_ws("-", F.lit("S"), F.conv(F.substring(h, 1, 2), 16, 10), authority, F.when(count > 0, F.array_join(subs, "-"))))


def collapse(text: Column, width: int = 496) -> Column:
    """Runs of white space as one blank, cut to a display width."""
    return F.substring(F.regexp_replace(text, r"[\n\r\t ]+", " "), 1, width)

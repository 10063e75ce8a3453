"""Program-cache entries, software inventories and usage settings from the documents of registry hives.

All of it is filters and projections over the key documents that :func:`files.read` gives
for hives; only the cache's own binary value is decoded in Python, one value per hive.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import forensic as fx

#: Fixed values of the format.
EXECUTED = 2
_KEY = "key_name string, key_path string, last_modified string, values array<struct<name:string,type:string,data:string>>, subkeys array<string>"
_ENTRY = "source string, position int, controlset int, cache_version string, entry string, executed boolean, last_modified_ft bigint, path_size int, signature string, error string"
_CACHE = r"(?i)^ControlSet\d{3}\\Control\\Session Manager\\AppCompatCache$"


class Unsupported(ValueError):
    """A cache of a kind that is not decoded."""


def _path(raw: bytes) -> str:
    return raw.decode("utf-16-le", "replace")


def _signed(data: bytes, at: int, head: bytes, package: bool) -> Iterator[tuple]:
    """Entries that each begin with ``head``; those with a package have flags as well."""
    while at + 20 < len(data) and data[at : at + 4] == head:
        n = struct.unpack_from("<H", data, at + 12)[0]
        p = at + 14 + n
        executed = None
        if package:
            p += 2 + struct.unpack_from("<H", data, p)[0]
            executed = bool(struct.unpack_from("<I", data, p)[0] & EXECUTED)
            p += 8
        written, size = struct.unpack_from("<QI", data, p)
        yield _path(data[at + 14 : at + 14 + n]), executed, written, n, head.decode()
        at = p + 12 + (size if p + 12 + size <= len(data) else 0)


def _rows(data: bytes, wide: bool) -> Iterator[tuple]:
    """Entries as rows of fixed size whose paths lie elsewhere."""
    step, form = (48, "<HHIQQI") if wide else (32, "<HHIQI")
    for i in range(struct.unpack_from("<I", data, 4)[0]):
        at = 128 + step * i
        if at + step > len(data):
            return
        n, _, *rest = struct.unpack_from(form, data, at)
        place, written, flags = rest[-3:]
        path = _path(data[place : place + n])
        yield path[4:] if path.startswith("\\??\\") else path, bool(flags & EXECUTED), written, n, None


def decode(data: bytes, narrow: bool = False) -> tuple[str, list[tuple]]:
    """(version, entries) of a cache: path or program entry, executed, FILETIME, bytes of the path, signature.

    ``narrow``: the hive is of a 32-bit system."""
    if len(data) < 4:
        raise Unsupported("program cache too small")
    number = struct.unpack_from("<I", data)[0]
    try:
        if number in (0xDEADBEEF, 0xBADC0FFE):
            raise Unsupported("program caches of this age are not supported")
        if number == 0xBADC0FEE:
            return ("Windows 7 32-bit", list(_rows(data, False))) if narrow else ("Windows 7 64-bit or Windows Server 2008 R2", list(_rows(data, True)))
        head = data[128:132]
        if len(data) >= 132 and head in (b"00ts", b"10ts"):
            name = "Windows 8 or Windows Server 2012" if head == b"00ts" else "Windows 8.1 or Windows 2012 R2"
            found = [(r"C:" + e[0][6:] if e[0].startswith("SYSVOL\\") else e[0], *e[1:]) for e in _signed(data, 128, head, True)]
            return name, found
        at = number if data[number : number + 4] == b"10ts" else data.find(b"10ts")
        if at < 0:
            raise Unsupported("unknown kind of program cache")
        return "Windows 10 Creators" if at == number == 0x34 else "Windows 10", list(_signed(data, at, b"10ts", False))
    except struct.error as e:
        raise Unsupported(f"damaged program cache: {e}") from e


def hive_keys(documents: DataFrame) -> DataFrame:
    """The keys of registry documents: source, key_name, key_path, last_modified, values, subkeys. Data are texts."""
    read = documents.where((F.col("kind") == "hve") & F.col("data").isNotNull()).select("source", F.from_json("data", _KEY).alias("k"))
    return read.select("source", "k.*")


def keys_at(keys: DataFrame, path: str) -> DataFrame:
    """The key at a path, names in any letter case."""
    return keys.where(F.lower("key_path") == path.lower())


def value(name: str, values: str = "values") -> Column:
    """The data of the value of exactly this name; null without it."""
    return F.get(F.filter(values, lambda v: v["name"] == name), F.lit(0))["data"]


def moment(text: Column) -> Column:
    return F.try_to_timestamp(text)


def cache_entries(keys: DataFrame) -> DataFrame:
    """The entries of each hive's current program cache, in order, with how the cache was written.

    source, position, controlset, cache_version, path (of files), program_entry (of programs)
    with its fields, executed, last_modified_ts, path_size, signature, last_update_ts. A
    cache that cannot be decoded gives one row with ``error``."""
    current = keys_at(keys, "Select").select("source", value("Current").try_cast("int").alias("controlset"))
    number = F.regexp_extract("key_path", r"(?i)^ControlSet(\d{3})\\", 1).cast("int")
    caches = keys.where(F.col("key_path").rlike(_CACHE)).select("source", number.alias("controlset"), value("AppCompatCache").alias("data"), "last_modified")
    narrow = keys.where(F.col("key_path").rlike(r"(?i)^ControlSet\d{3}\\Control\\Session Manager\\Environment$")).select(
        "source", number.alias("controlset"), (value("PROCESSOR_ARCHITECTURE") == "x86").alias("narrow")
    )
    wanted = caches.join(current, ["source", "controlset"]).join(narrow, ["source", "controlset"], "left")

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in _ENTRY.split(", ")]
        for pdf in batches:
            rows = []
            for source, controlset, data, narrow in zip(pdf["source"], pdf["controlset"], pdf["data"], pdf["narrow"]):
                try:
                    version, found = decode(bytes.fromhex(data or ""), narrow is True)
                    rows += [(source, i, controlset, version, path, ran, min(ft, 2**63 - 1), n, sign, None) for i, (path, ran, ft, n, sign) in enumerate(found)]
                except ValueError as e:
                    rows.append((source, None, controlset, None, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=names, dtype=object)
            for c in ("position", "controlset", "path_size"):
                out[c] = out[c].astype("Int32")
            out["last_modified_ft"] = out["last_modified_ft"].astype("Int64")
            yield out

    rows = wanted.select("source", "controlset", "data", "narrow").mapInPandas(run, _ENTRY)
    program = F.coalesce(fx.is_program_entry(F.col("entry")), F.lit(False))
    fields = fx.program_fields(F.col("entry"))
    ticks = F.col("last_modified_ft")
    written = F.when(ticks > 0, F.timestamp_micros(F.floor((ticks - fx.EPOCH_TICKS).cast("decimal(20,0)") / 10).cast("bigint")))
    shaped = rows.select(
        "source", "position", "controlset", "cache_version", F.when(~program, F.col("entry")).alias("path"), F.when(program, F.col("entry")).alias("program_entry"),
        *[c.alias(n) for n, c in fields.items()], "executed", written.alias("last_modified_ts"), "path_size", "signature", "error",
    )
    updated = wanted.select("source", "controlset", moment(F.col("last_modified")).alias("last_update_ts"))
    return shaped.join(updated, ["source", "controlset"], "left")


def _new_layout(keys: DataFrame) -> DataFrame:
    return keys_at(keys, r"Root\InventoryApplicationFile").select("source").distinct()


def inventory_files(keys: DataFrame) -> DataFrame:
    """The files of software inventories, new or old layout: source, path, file_id, sha1, program_id, file_ts."""
    new = keys.where(F.col("key_path").rlike(r"(?i)^Root\\InventoryApplicationFile\\[^\\]+$")).select("*", F.lit(True).alias("__new"))
    old = keys.where(F.col("key_path").rlike(r"(?i)^Root\\File\\[^\\]+\\[^\\]+$")).join(_new_layout(keys), "source", "left_anti").select("*", F.lit(False).alias("__new"))
    both = new.unionByName(old)
    either = lambda a, b: F.when(F.col("__new"), value(a)).otherwise(value(b))
    file_id = either("FileId", "101")
    return both.select(
        "source", "key_path", either("LowerCaseLongPath", "15").alias("path"), file_id.alias("file_id"), fx.sha1_of_file_id(file_id).alias("sha1"),
        either("ProgramId", "100").alias("program_id"), moment(F.col("last_modified")).alias("file_ts"),
    )


def inventory_programs(keys: DataFrame) -> DataFrame:
    """The programs of software inventories: source, program_id, program_name, version, root_directory, uninstall, program_ts."""
    new = keys.where(F.col("key_path").rlike(r"(?i)^Root\\InventoryApplication\\[^\\]+$")).join(_new_layout(keys), "source", "left_semi").select("*", F.lit(True).alias("__new"))
    old = keys.where(F.col("key_path").rlike(r"(?i)^Root\\Programs\\[^\\]+$")).join(_new_layout(keys), "source", "left_anti").select("*", F.lit(False).alias("__new"))
    both = new.unionByName(old)
    either = lambda a, b: F.when(F.col("__new"), value(a)).otherwise(value(b))
    return both.select(
        "source", F.col("key_name").alias("program_id"), either("Name", "0").alias("program_name"), either("Version", "1").alias("version"),
        F.when(F.col("__new"), value("RootDirPath")).alias("root_directory"), F.when(F.col("__new"), value("UninstallString")).alias("uninstall"),
        moment(F.col("last_modified")).alias("program_ts"),
    )


_USAGE = r"Microsoft\\Windows NT\\CurrentVersion\\SRUM"
_SETTINGS = ("Tier1Period", "Tier2Period", "Tier2MaxEntries", "Tier2LongTermPeriod", "Tier2LongTermMaxEntries")


def usage_parameters(keys: DataFrame) -> DataFrame:
    """The common settings of resource usage, one row per hive that has them; unset ones are null."""
    return keys.where(F.col("key_path").rlike(rf"(?i)^{_USAGE}\\Parameters$")).select("source", *[value(n).try_cast("bigint").alias(n) for n in _SETTINGS])


def usage_extensions(keys: DataFrame) -> DataFrame:
    """The tables of resource usage and their own settings: source, guid (upper case), table_name, dll_path, long_term, settings."""
    return keys.where(F.col("key_path").rlike(rf"(?i)^{_USAGE}\\Extensions\\[^\\]+$")).select(
        "source", F.upper("key_name").alias("guid"), F.coalesce(value(""), value("(default)")).alias("table_name"), value("DllName").alias("dll_path"),
        F.exists("values", lambda v: v["name"] == "LastLongTermUpdate").alias("long_term"), *[value(n).try_cast("bigint").alias(n) for n in _SETTINGS],
    )


def users(keys: DataFrame) -> DataFrame:
    """The users of a hive's profile list: source, sid (the key's name), sid_hex, user."""
    return keys.where(F.col("key_path").rlike(r"(?i)^Microsoft\\Windows NT\\CurrentVersion\\ProfileList\\[^\\]+$")).select(
        "source", F.col("key_name").alias("sid"), value("Sid").alias("sid_hex"), fx.last_path_part(value("ProfileImagePath")).alias("user")
    )

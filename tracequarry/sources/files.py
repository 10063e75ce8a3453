"""Artefact files: discovery, kinds, and readers that give one row per document.

Every reader returns source, kind, record_id, timestamp and data (JSON text). The driver
only lists files and cuts them into ranges; tasks read their range from the shared store,
pass documents on in small batches, and never hold a file as one row. JSON Lines, event
logs and file tables are cut into ranges of ``SPLIT`` bytes; JSON arrays and ESE databases
are streamed by one task each, registry hives and XML documents read whole by one.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracequarry.functions.forensic import size_text
from tracequarry.sources import store

#: Kinds of artefact files by extension.
KINDS = {
    "evtx": ("evt", "evtx"), "hve": ("hve",), "json": ("json",), "jsonl": ("jsonl",), "mft": ("mft", "bin"), "xml": ("xml",), "esedb": ("dat", "edb"),
}
DOCUMENT = "source string, kind string, record_id bigint, timestamp string, data string, error string"
#: Kinds whose files are cut into ranges.
DIVISIBLE = ("jsonl", "evtx", "mft")
#: Documents, and characters of them, that are passed on at once.
BATCH, BATCH_CHARACTERS = 5_000, 16_000_000
_BLANKS = re.compile(r"[ \t\n\r]*")


def kind_of(path: Column) -> Column:
    """The kind of a file by its extension in any letter case, or by its name ``$MFT``."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("unknown")
    for kind, extensions in KINDS.items():
        out = F.when(ext.isin(*extensions), kind).otherwise(out)
    return F.when(path.rlike(r"(^|[/\\])\$MFT$"), "mft").otherwise(out)


def kind_of_path(path: str) -> str:
    """:func:`kind_of` for one path."""
    name = path.replace("\\", "/").rpartition("/")[2]
    if name == "$MFT":
        return "mft"
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    return next((k for k, v in KINDS.items() if ext in v), "unknown")


def extensions_of(kind: str) -> list[str]:
    """The extensions of a kind's files; file tables are also known by their name."""
    return [*KINDS.get(kind, ()), *(["$MFT"] if kind == "mft" else [])]


def discover(paths: Sequence[str], extensions: Sequence[str] | None = None, skip_errors: bool = False) -> list[str]:
    """Files at or under paths, sorted; extensions compare with letter case and without a dot."""
    return [p for p, _ in store.discover_sized([str(p) for p in paths], extensions, skip_errors)]


def sizes(spark: SparkSession, paths: Sequence[str], extensions: Sequence[str] | None = None, skip_errors: bool = False) -> DataFrame:
    """Files and bytes by kind: kind, n_files, n_bytes and the size as text."""
    rows = [(kind_of_path(p), n) for p, n in store.discover_sized([str(p) for p in paths], extensions, skip_errors)]
    listed = spark.createDataFrame(rows, "kind string, size bigint")
    summed = listed.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return summed.withColumn("size", size_text(F.col("n_bytes")))


def _refuse(name: str):
    raise ValueError(name)


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _loads(text: str):
    return json.loads(text, parse_constant=_refuse)


def json_lines(source: store.Source, start: int, length: int) -> Iterator[tuple[int, str | None, str | None]]:
    """(line in the range from 1, JSON text, error) of a range; blank lines give nothing; an unreadable line ends it."""
    for n, line in enumerate(source.lines(start, length), 1):
        if not line.strip():
            continue
        try:
            yield n, compact(_loads(line.decode("utf-8", "replace"))), None
        except (ValueError, RecursionError) as e:
            yield n, None, str(e)
            return


def _characters(source: store.Source, block: int) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    for at in range(0, source.size, block):
        yield decoder.decode(source.read(at, block))
    yield decoder.decode(b"", True)


def array_items(source: store.Source, block: int) -> Iterator[object]:
    """The elements of a file that is one JSON array, one after the other, so that the file need not fit into memory."""
    pieces = _characters(source, block)
    decode = json.JSONDecoder(parse_constant=_refuse).raw_decode
    text, at, ended = "", 0, False

    def more() -> bool:
        nonlocal text, at, ended
        if ended:
            return False
        # as much again as is held, so that a long element is not begun too often
        got: list[str] = []
        wanted, n = max(1, len(text) - at), 0
        while n < wanted:
            piece = next(pieces, None)
            if piece is None:
                ended = True
                break
            got.append(piece)
            n += len(piece)
        text, at = text[at:] + "".join(got), 0
        return True

    def peek() -> str:
        nonlocal at
        while True:
            at = _BLANKS.match(text, at).end()
            if at < len(text):
                return text[at]
            if not more():
                return ""

    if peek() != "[":
        raise ValueError("not an array")
    at += 1
    if peek() == "]":
        at += 1
    else:
        while True:
            peek()
            while True:
                try:
                    value, end = decode(text, at)
                except ValueError:
                    if not more():
                        raise
                    continue
                goes_on = end == len(text) or (isinstance(value, (int, float)) and text[end] in "0123456789.eE+-")
                if not goes_on or not more():  # a number at the end of what is held may go on
                    break
            yield value
            at = end
            ch = peek()
            if ch not in (",", "]"):
                raise ValueError(f"expected a comma or the end of the array, got {ch!r}")
            at += 1
            if ch == "]":
                break
    if peek():
        raise ValueError("more than one value")


def json_documents(source: store.Source, block: int = 1 << 20) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(record id, JSON text, error). An array gives one document per element, anything else is one.

    An array is read twice, first to see that it is valid to its end: a file that is not
    gives an error and no document."""
    try:
        head = source.read(0, 4096).lstrip(b"\xef\xbb\xbf \t\r\n")
        if head.startswith(b"["):
            for _ in array_items(source, block):
                pass
        else:
            value = _loads(source.read(0, source.size).decode("utf-8-sig"))
    except (ValueError, RecursionError) as e:
        yield None, None, str(e)
        return
    if not head.startswith(b"["):
        yield None, compact(value), None
        return
    for i, item in enumerate(array_items(source, block)):
        yield i, compact(item), None


def element_value(e) -> object:
    """An XML element as a value: attributes as ``@name``, text as ``$text``, repeated children as arrays,
    a leaf without attributes as its text; ``EventData`` and ``UserData`` flatten to name and value."""
    tag = lambda x: x.tag.rpartition("}")[2]
    if tag(e) in ("EventData", "UserData"):
        out: dict = {}
        for c in e:
            name, text = (c.get("Name") or tag(c)) if tag(c) == "Data" else tag(c), (c.text or "").strip()
            if tag(c) == "Data" and not c.get("Name"):
                name = "Data"
                if not text:
                    continue
            value = element_value(c) if len(c) else (text or None)
            if name in out:
                out[name] = [*out[name], value] if isinstance(out[name], list) else [out[name], value]
            else:
                out[name] = value
        return out or None
    text = (e.text or "").strip()
    if not len(e) and not e.attrib:
        return text
    out = {f"@{k.rpartition('}')[2]}": v for k, v in e.attrib.items()}
    if text:
        out["$text"] = text
    for c in e:
        name, value = tag(c), element_value(c)
        if name in out:
            out[name] = [*out[name], value] if isinstance(out[name], list) else [out[name], value]
        else:
            out[name] = value
    return out


def xml_document(content: bytes) -> tuple[int | None, str | None, str | None]:
    """The one document of an XML file. Files that declare entities are refused."""
    import xml.etree.ElementTree as ET

    if b"<!ENTITY" in content:
        return None, None, "entity declarations are not allowed"
    try:
        root = ET.fromstring(content)
        return None, compact({root.tag.rpartition("}")[2]: element_value(root)}), None
    except (ET.ParseError, RecursionError) as e:
        return None, None, str(e)


def sniff(source: store.Source) -> list[str]:
    """The kinds that a file of unknown name may be of, likeliest first, by what it begins with."""
    head = source.read(0, 4096)
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if head.startswith(b"ElfFile\0"):
        return ["evtx"]
    if head[:4] in (b"FILE", b"BAAD"):
        return ["mft"]
    if head.startswith(b"regf"):
        return ["hve"]
    if head[4:8] == b"\xef\xcd\xab\x89":
        return ["esedb"]
    return ["xml", "json"] if text.startswith(b"<") else ["json", "xml"]


def _event_log(source: store.Source, start: int, length: int) -> Iterator[tuple]:
    from tracequarry.sources import evtx

    if source.read(0, 8) != evtx.FILE_MAGIC:
        if start == 0:
            yield None, None, None, "not an event log"
        return
    for at in evtx.chunk_starts(source.size):
        if start <= at < start + length:
            try:
                chunk = evtx.Chunk(source.read(at, evtx.CHUNK))
            except evtx.Damaged:
                continue  # space that was never written
            for number, time, value, error in chunk.records():
                yield number, time, None if value is None else compact(value), error


def _documents(path: str, kind: str, start: int, length: int, resident_data: bool, unknown: bool) -> Iterator[tuple]:
    """(kind, record id, timestamp, data, error), and a file-table entry's (parent, name), of one range of a file."""
    with store.Source(path) as source:
        if kind == "unknown" and not unknown:
            yield kind, None, None, None, "file type is not currently supported"
            return
        for of in sniff(source) if kind == "unknown" else [kind]:
            got = _of_kind(source, path, of, start, length, resident_data)
            first = next(got, None)
            if kind == "unknown" and (first is None or first[3]):
                continue  # not of that kind after all
            if first is not None:
                yield of, *first
                for rest in got:
                    yield of, *rest
            return
        yield kind, None, None, None, "file type is not currently supported"


def _of_kind(source: store.Source, path: str, kind: str, start: int, length: int, resident_data: bool) -> Iterator[tuple]:
    """(record id, timestamp, data, error)."""
    if kind == "jsonl":
        for n, text, error in json_lines(source, start, length):
            yield n, None, text, error
    elif kind == "json":
        for n, text, error in json_documents(source):
            yield n, None, text, error
    elif kind == "xml":
        n, text, error = xml_document(source.read(0, source.size))
        yield n, None, text, error
    elif kind == "evtx":
        yield from _event_log(source, start, length)
    elif kind == "mft":
        from tracequarry.sources import mft

        try:
            for e, link in mft.range_entries(source, start, length, resident_data):
                yield e["EntryId"], None, compact(e), None, link
        except ValueError as e:
            yield None, None, None, str(e)
    elif kind == "hve":
        from tracequarry.sources import hive

        yield from hive.documents(source, hive.logs_of(path))
    elif kind == "esedb":
        from tracequarry.sources import ese

        yield from ese.documents(source)
    else:
        yield None, None, None, "file type is not currently supported"


def ranges(files: Sequence[tuple[str, int]], kind: str | None, split: int) -> list[tuple[str, str, int, int]]:
    """(path, kind, start, bytes) of the ranges that tasks read."""
    out = []
    for path, size in files:
        of = kind or kind_of_path(path)
        step = split if of in DIVISIBLE else max(size, 1)
        out += [(path, of, at, step) for at in range(0, max(size, 1), step)]
    return out


def read(
    spark: SparkSession,
    paths: Sequence[str],
    kind: str | None = None,
    extensions: Sequence[str] | None = None,
    skip_errors: bool = False,
    load_unknown: bool = False,
    resident_data: bool = False,
    split: int = store.SPLIT,
) -> DataFrame:
    """Documents of event-log, registry, ESE, file-table, JSON, JSON Lines and XML files.

    The kind comes from the file's name unless given; with ``load_unknown`` other files are
    taken for what they begin with. An unreadable file gives one row with ``error`` and no
    data, which ``skip_errors`` leaves out. JSON Lines end at their first unreadable line,
    and their record ids are line numbers, also where a file is read in ranges. The paths
    of file-table entries in files of more than one range come from the parent-child
    operator, so no task holds a whole table's names.
    """
    files = store.discover_sized([str(p) for p in paths], extensions, skip_errors)
    if not files:
        return spark.createDataFrame([], DOCUMENT)
    todo = ranges(files, kind, split)
    tasks = max(1, min(len(todo), 50 * spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame(todo, "source string, kind string, start bigint, length bigint").repartition(tasks, "source", "start")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ("source", "kind", "start", "record_id", "timestamp", "data", "error", "parent", "name")
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        rows: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path, of, start, length in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    for found, number, time, data, error, *link in _documents(path, of, start, length, resident_data, load_unknown):
                        parent, name = (link[0] if link else None) or (None, None)
                        rows.append((path, found, start, number, time, data, error, parent, name))
                        held += len(data or "")
                        if len(rows) >= BATCH or held >= BATCH_CHARACTERS:
                            yield flush()
                            rows.clear()
                            held = 0
                except OSError as e:
                    rows.append((path, of, start, None, None, None, str(e), None, None))
        if rows:
            yield flush()

    got = table.mapInArrow(run, "source string, kind string, start bigint, record_id bigint, timestamp string, data string, error string, parent bigint, name string")
    cut = {path for path, _, start, _ in todo if start}
    if any(of == "jsonl" and start for _, of, start, _ in todo):
        got = _numbered(got, table.where("kind = 'jsonl'"))
    else:
        got = got.withColumn("error", F.when((F.col("kind") == "jsonl") & F.col("error").isNotNull(), F.concat(F.lit("line "), F.col("record_id").cast("string"), F.lit(": "), F.col("error"))).otherwise(F.col("error")))
    if any(of == "mft" for path, of, _, _ in todo if path in cut):
        got = _with_paths(got)
    out = got.drop("start", "parent", "name")
    return out.where(F.col("error").isNull()) if skip_errors else out


def _numbered(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Line numbers within files for lines numbered within ranges, and nothing behind a file's first unreadable line.

    Joined by (file, range) with one small row per range."""

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for path, _, start, length in zip(*(c.to_pylist() for c in b.columns)):
                n, bad = 0, None
                with store.Source(path) as source:
                    for n, line in enumerate(source.lines(start, length), 1):
                        if bad is None and line.strip():
                            try:
                                _loads(line.decode("utf-8", "replace"))
                            except (ValueError, RecursionError):
                                bad = n
                out.append((path, start, n, bad))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["source", "start", "n", "bad"])

    before = W.partitionBy("source").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    counts = table.mapInArrow(count, "source string, start bigint, n bigint, bad bigint").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("__end", F.min(F.col("before") + F.col("bad")).over(W.partitionBy("source"))).select("source", "start", "before", "__end")
    lines = F.col("kind") == "jsonl"
    joined = rows.join(counts, ["source", "start"], "left")
    number = F.when(lines, F.col("record_id") + F.col("before")).otherwise(F.col("record_id"))
    joined = joined.withColumn("record_id", number).where(~lines | F.col("__end").isNull() | (F.col("record_id") <= F.col("__end")))
    text = F.concat(F.lit("line "), F.col("record_id").cast("string"), F.lit(": "), F.col("error"))
    return joined.withColumn("error", F.when(lines & F.col("error").isNotNull(), text).otherwise(F.col("error"))).select(*rows.columns)


def _with_paths(rows: DataFrame) -> DataFrame:
    """Full paths for the file-table entries that have none yet, from their parent links."""
    from tracequarry.operators.hierarchy import hierarchy
    from tracequarry.sources import mft

    open_ = (F.col("kind") == "mft") & F.col("data").isNotNull() & ~F.col("data").contains('"FullPath":')
    parent = F.col("parent")
    links = rows.where(open_ & F.col("name").isNotNull()).select(
        F.xxhash64("source").alias("g"), F.col("record_id").alias("v"), F.when((parent != mft.ROOT_ENTRY) & (parent != F.col("record_id")), parent).alias("p"), "name"
    )
    paths = hierarchy(links, "g", "v", "p", "name").select(F.col("g").alias("__g"), F.col("v").alias("__v"), F.struct(F.col("path").alias("FullPath")).alias("__path"))
    joined = rows.withColumn("__k", F.when(open_, F.xxhash64("source"))).join(paths, (F.col("__k") == F.col("__g")) & (F.col("record_id") == F.col("__v")), "left")
    member = F.coalesce(F.to_json("__path"), F.lit('{"FullPath":""}'))
    whole = F.concat(F.expr("substring(data, 1, length(data) - 1)"), F.lit(","), F.substring(member, 2, 2**31 - 1))
    return joined.withColumn("data", F.when(open_, whole).otherwise(F.col("data"))).select(*rows.columns)

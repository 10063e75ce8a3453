"""Attribute-value rows into one wide, typed row per entity (problem 1).

Plan: parse every value to its attribute's type inside the JVM, keep the latest usable
value of each (entity, attribute) with an algebraic ``max_by`` (combined before the
shuffle, so a hot entity costs one partial row per task and attribute), then sort by
entity and stream the sorted rows into sparse columnar batch builders: one typed buffer
and one validity mask per attribute, flushed as Arrow record batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.runtime import many_columns

#: Marks that stand for an absent, unknown or failed value.
VOID_MARKS = ("", "?", "-", "n/a", "<error>", "(value not set)", "(null)", "null", "<null>", "unknown", "<unknown>")
#: Registry types that carry no value.
VOID_TYPES = ("none", "error")
#: Fixed value: what counts as a blank.
BLANKS = " \t\n\x0b\f\r"
#: Spark type of each kind of attribute.
KINDS = {"int": "bigint", "datetime": "timestamp", "list": "array<string>", "bytes": "binary", "text": "string"}


@dataclass(frozen=True)
class Attribute:
    """A wanted attribute: its name as it will be spelt, and its kind (a key of ``KINDS``)."""

    name: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of attribute: {self.kind}")


def attribute_key(name: Column) -> Column:
    """A name without letter case, NULs, surrounding blanks and quotes."""
    return F.lower(F.btrim(_without_nuls(name), F.lit(BLANKS + "\"'")))


def _without_nuls(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def _trimmed(data: Column) -> Column:
    return F.btrim(_without_nuls(data), F.lit(BLANKS))


def _hex_bytes(data: Column) -> Column:
    """The digits of ``hex:aa,bb``, ``hex(7):aa,bb``, ``0xAABB``, ``aa bb``, ``aa-bb`` or ``aabb``; else null."""
    body = F.regexp_replace(F.lower(data), r"^(hex(\([0-9a-f]+\))?:|0x)", "")
    digits = F.regexp_replace(body, r"[\s,:\-\\]+", "")
    return F.when(digits.rlike(r"^([0-9a-f]{2})+$"), digits)


def _reversed_hex(digits: Column) -> Column:
    pairs = F.regexp_extract_all(digits, F.lit("([0-9a-f]{2})"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def parse_int(data: Column) -> Column:
    """Decimal digits (blanks around, thousands separators), ``0x`` and ``dword:`` hex with or
    without the decimal in brackets, ``hex(b):``/``hex(4):`` little-endian and ``hex(5):``
    big-endian bytes, as bigint; null for anything else or beyond bigint."""
    s = F.lower(_trimmed(data))
    plain = s.rlike(r"^[+-]?\d+$")
    grouped = s.rlike(r"^[+-]?\d{1,3}([,' ]\d{3})+$")
    hexed = F.regexp_extract(s, r"^(?:0x|dword:|qword:)([0-9a-f]{1,16})(?:\s*\(\d+\))?$", 1)
    little = F.regexp_extract(s, r"^hex\((?:b|4)\):((?:[0-9a-f]{2},?){1,8})$", 1)
    big = F.regexp_extract(s, r"^hex\(5\):((?:[0-9a-f]{2},?){1,8})$", 1)

    def unhex(digits: Column) -> Column:
        return F.conv(digits, 16, 10).cast("decimal(20,0)").try_cast("bigint")

    return (
        F.when(plain, s.try_cast("bigint"))
        .when(grouped, F.regexp_replace(s, "[,' ]", "").try_cast("bigint"))
        .when(hexed != "", unhex(hexed))
        .when(little != "", unhex(_reversed_hex(F.regexp_replace(little, ",", ""))))
        .when(big != "", unhex(F.regexp_replace(big, ",", "")))
    )


def parse_datetime(data: Column) -> Column:
    """``M/d/yyyy H:m:s`` (month first), ISO with ``T`` or a blank, ``yyyyMMddHHmmss``; null if impossible."""
    s = _trimmed(data)
    digits = F.regexp_replace(s, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")
    iso = F.regexp_replace(digits, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.\d+)?Z?$", "$1 $2")
    iso = F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(iso, F.lit(" 00:00:00"))).otherwise(iso)
    slashed = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat(s, F.lit(" 00:00:00"))).otherwise(s)
    twelve = F.upper(s)
    return (
        F.when(iso.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")))
        .when(slashed.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d$"), F.try_to_timestamp(slashed, F.lit("M/d/yyyy H:mm:ss")))
        .when(twelve.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d [AP]M$"), F.try_to_timestamp(twelve, F.lit("M/d/yyyy h:mm:ss a")))
    )


def parse_list(data: Column) -> Column:
    """A JSON array of strings, NUL- or line-separated items, or ``hex(7):`` UTF-16 bytes; without empty items."""
    lead = F.btrim(data, F.lit(BLANKS))
    as_json = F.when(lead.startswith("["), F.from_json(lead, "array<string>"))
    digits = F.when(F.lower(lead).startswith("hex(7):"), _hex_bytes(lead))
    wide = F.decode(F.unhex(digits), "UTF-16LE")
    items = F.coalesce(as_json, F.split(F.coalesce(wide, data), r"[\x00\r\n]+"))
    clean = F.transform(items, lambda x: F.btrim(x, F.lit(BLANKS)))
    kept = F.filter(clean, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def parse_bytes(data: Column) -> Column:
    """Hex digits in any letter case and with any of the usual separators or prefixes, as binary."""
    return F.unhex(_hex_bytes(_trimmed(data)))


def parse_text(data: Column) -> Column:
    """The text without NULs and surrounding blanks; ``hex(1):``/``hex(2):`` UTF-16 bytes are decoded."""
    s = _trimmed(data)
    digits = F.when(F.lower(s).rlike(r"^hex\([12]\):"), _hex_bytes(s))
    text = F.coalesce(_trimmed(F.decode(F.unhex(digits), "UTF-16LE")), s)
    return F.when(text != "", text)


PARSERS = {"int": parse_int, "datetime": parse_datetime, "list": parse_list, "bytes": parse_bytes, "text": parse_text}


def latest_values(
    rows: DataFrame,
    attributes: Sequence[Attribute],
    entity: str = "key_id",
    name: str = "value_name",
    kind: str = "value_type",
    data: str = "value_data",
    order: Sequence[str] = ("collected_at", "row_id"),
) -> DataFrame:
    """The latest usable value of each (entity, attribute).

    Returns ``entity``, ``__attr`` (the attribute's column index) and one column for each
    kind present, of which the one of the attribute's own kind is filled. Rows with a null
    entity, name or data, of a void type, with a void mark or with data that does not parse
    to the attribute's kind are left out. ``order`` decides which value is latest; null
    sorts lowest; exact repeats collapse.
    """
    index = {a.name.lower(): i for i, a in enumerate(attributes)}
    if len(index) != len(attributes):
        raise ValueError("attribute names must differ in more than letter case")
    kinds = [k for k in KINDS if any(a.kind == k for a in attributes)]
    lookup = F.create_map(*[F.lit(x) for pair in index.items() for x in pair])
    picked = rows.select(
        F.col(entity).alias("__entity"),
        F.element_at(lookup, attribute_key(F.col(name))).alias("__attr"),
        F.lower(F.trim(F.col(kind))).alias("__kind"),
        F.col(data).alias("__data"),
        F.struct(*[F.col(c) for c in order]).alias("__order"),
    )
    usable = picked.where(
        F.col("__entity").isNotNull()
        & F.col("__attr").isNotNull()
        & F.col("__data").isNotNull()
        & ~F.coalesce(F.col("__kind").isin(*VOID_TYPES), F.lit(False))
        & ~F.lower(_trimmed(F.col("__data"))).isin(*VOID_MARKS)
    )
    values = {}
    for k in kinds:
        own = [i for i, a in enumerate(attributes) if a.kind == k]
        values[k] = F.when(F.col("__attr").isin(*own), PARSERS[k](F.col("__data")))
    parsed = usable.select("__entity", "__attr", "__order", *[v.alias(f"__{k}") for k, v in values.items()])
    # a row without a value has no order and is passed over; as a filter this would be pushed down and parse everything twice
    best = parsed.groupBy("__entity", "__attr").agg(
        F.max_by(F.struct(*[F.col(f"__{k}") for k in kinds]), F.when(_any_filled(kinds), F.col("__order"))).alias("__v")
    ).where(F.col("__v").isNotNull())
    return best.select(F.col("__entity").alias(entity), "__attr", *[F.col(f"__v.__{k}").alias(f"__{k}") for k in kinds])


def _any_filled(kinds: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in kinds:
        out = out | F.col(f"__{k}").isNotNull()
    return out


def _flush(pa, kinds_of, names, entity, schema, entities, attr, columns):
    """One record batch: for each attribute a validity mask over the entities and its typed buffer."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate(([True], entities[1:] != entities[:-1])))
    slot = np.cumsum(np.concatenate(([0], (entities[1:] != entities[:-1]).astype(np.int64))))
    n = len(starts)
    arrays = [pa.array(entities[starts])]
    order = np.argsort(attr, kind="stable")
    bounds = np.searchsorted(attr[order], np.arange(len(names) + 1))
    for i in range(len(names)):
        at = order[bounds[i] : bounds[i + 1]]
        source = np.zeros(n, dtype=np.int64)
        valid = np.zeros(n, dtype=bool)
        source[slot[at]] = at
        valid[slot[at]] = True
        arrays.append(columns[kinds_of[i]].take(pa.array(source, mask=~valid)))
    return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, schema.types)], schema=schema)


def to_wide(latest: DataFrame, attributes: Sequence[Attribute], entity: str = "key_id", batch: int = 20_000) -> DataFrame:
    """Stream the rows of :func:`latest_values`, sorted by entity, into wide typed rows.

    One row per entity with at least one filled attribute; a missing attribute is null.
    ``batch`` bounds how many attribute rows one builder holds before it is flushed (an
    entity adds at most one row per attribute to that). The entity must be an integer.
    """
    names = [a.name for a in attributes]
    kinds_of = [a.kind for a in attributes]
    schema_text = f"`{entity}` bigint, " + ", ".join(f"`{a.name}` {KINDS[a.kind]}" for a in attributes)

    def build(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds_pa = {"int": pa.int64(), "datetime": pa.timestamp("us", tz="UTC"), "list": pa.list_(pa.string()), "bytes": pa.binary(), "text": pa.string()}
        schema = pa.schema([(entity, pa.int64()), *[(n, kinds_pa[k]) for n, k in zip(names, kinds_of)]])
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < batch:
                continue
            ids = held.column(0).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last entity may go on in the next batch
            if cut:
                yield _flush(pa, kinds_of, names, entity, schema, *_parts(held.slice(0, cut)))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _flush(pa, kinds_of, names, entity, schema, *_parts(held))

    def _parts(t):
        cols = {c[2:]: t.column(c).combine_chunks() for c in t.column_names if c.startswith("__") and c != "__attr"}
        return t.column(0).to_numpy(), t.column("__attr").to_numpy(), cols

    ordered = latest.withColumn(entity, F.col(entity).cast("bigint")).repartition(entity).sortWithinPartitions(entity, "__attr")
    return ordered.mapInArrow(build, schema_text)


@many_columns()
def attributes_to_wide(rows: DataFrame, attributes: Sequence[Attribute], entity: str = "key_id", **columns) -> DataFrame:
    """Attribute-value rows to one wide row per entity; see :func:`latest_values` and :func:`to_wide`.

    Nulls in any column, void marks, unparsable data and unknown attributes fill no cell;
    an entity without any cell gives no row; an empty table gives an empty wide table;
    further columns of the input are ignored, whatever their names.
    """
    return to_wide(latest_values(rows, attributes, entity, **columns), attributes, entity)


@many_columns()
def wide_cells(wide: DataFrame, attributes: Sequence[Attribute], entity: str = "key_id") -> DataFrame:
    """The filled cells of a wide table as (entity, attr, cell) with canonical cell texts."""
    shown = []
    for a in attributes:
        c = F.col(f"`{a.name}`")
        text = {
            "int": lambda c: c.cast("string"),
            "datetime": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
            "list": lambda c: F.array_join(c, "|"),
            "bytes": lambda c: F.lower(F.hex(c)),
            "text": lambda c: c,
        }[a.kind](c)
        shown.append(F.struct(F.lit(a.name).alias("attr"), text.alias("cell")))
    pairs = wide.select(F.col(entity), F.explode(F.array(*shown)).alias("__p"))
    return pairs.select(entity, "__p.attr", "__p.cell").where(F.col("cell").isNotNull())

"""Search over documents: patterns over their text, field terms and a time range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.rules.compile import Compiler, TypedFields, VariantFields, portable_regex
from tracequarry.rules.ir import And, Node, Or
from tracequarry.rules.optimize import optimize
from tracequarry.rules.parse import parse_kv


def in_range(ts: Column, start: str | None, end: str | None) -> Column:
    """Strictly between the ends; a missing or unreadable time is outside any given range."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts > F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (ts < F.lit(end).cast("timestamp"))
    return out


def parse_timestamp(text: Column) -> Column:
    """ISO date and time, perhaps with a fraction (cut to microseconds) and what follows; else null."""
    m = r"^\s*(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d{1,6})?.*$"
    whole = F.regexp_replace(text, m, "$1 $2$3")
    return F.when(text.rlike(m), F.try_to_timestamp(whole))


def whole_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The compact JSON text of a row, in which patterns are looked for."""
    names = list(columns or df.columns)
    return F.replace(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])), F.lit("\\\\\\\\"), F.lit("\\\\"))


def search(
    df: DataFrame,
    patterns: Sequence[str] = (),
    terms: Sequence[str | Node] = (),
    ignore_case: bool = False,
    match_any: bool = False,
    timestamp: str | None = None,
    start: str | None = None,
    end: str | None = None,
    text: Column | None = None,
    variant: str | None = None,
) -> DataFrame:
    """The rows that match all (or any) of the patterns and of the terms, within the time range.

    ``text`` is what patterns are looked for in: by default the row's JSON text. Terms are
    ``key: value`` texts or expressions over the columns, or over the VARIANT column
    ``variant``. Time is tested first, then terms, then patterns. Without patterns and
    terms every row in the range is returned.
    """
    if timestamp is not None and (start is not None or end is not None):
        kind = dict(df.dtypes)[timestamp]
        ts = F.col(timestamp) if kind.startswith("timestamp") else parse_timestamp(F.col(timestamp).cast("string"))
        df = df.where(in_range(ts.cast("timestamp"), start, end))
    if terms:
        nodes = tuple(parse_kv(t) if isinstance(t, str) else t for t in terms)
        expression = optimize(Or(nodes) if match_any else And(nodes))
        df = df.where(Compiler(VariantFields(variant) if variant else TypedFields(df.schema)).predicate(expression))
    if patterns:
        where = whole_text(df) if text is None else text
        tests = [where.rlike(("(?i)" if ignore_case else "") + portable_regex(p)) for p in patterns]
        df = df.where(reduce(lambda a, b: a | b if match_any else a & b, tests))
    return df

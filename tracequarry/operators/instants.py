"""Timestamps of mixed forms, precisions, epochs and zones to one instant in UTC (problem 2).

A batch of texts is tokenised into character-class shape masks (digit, letter, other).
Each distinct mask is mapped to a parser once; the parser slices fixed columns out of the
character matrix of all texts of that mask, so conversion is array arithmetic. Local
readings go through zone transition tables that the driver takes, with their version,
from the JVM's time-zone rules and ships with the task; the version can be had as a column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.runtime import many_columns

#: Years that occur, unless others are asked for; readings outside are taken for no instants.
YEARS = (2019, 2026)
#: Zone texts that name a fixed offset; all others are looked up in the rules.
FIXED_OFFSET = r"^(UTC|GMT|UT)?[+-]\d{1,2}(:?[0-5]\d)?$"
#: Longest text that can be a timestamp; longer ones denote none.
WIDTH = 48
#: Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "BRT": -180, "IST": 330, "NPT": 345, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660,
}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Locales that put the month first in numeric dates.
MONTH_FIRST = ("en-US", "en-PH", "en-BZ", "fil-PH")
#: Seconds from 1970 back to the start of the epochs of 1601 and of year 1.
SINCE_1601, SINCE_0001 = 11_644_473_600, 62_135_596_800

_CLOCK = r"(?P<H>9{1,2}):(?P<M>99):(?P<S>99)"
_OFFSET = r"(?P<sign>[+-])(?P<oh>99):?(?P<om>99)"
_NAMED = r"(?P<mon>A{3})"
#: Shapes over masks (9: digit, A: letter). Groups name what the columns hold.
SHAPES = [
    rf"(?P<Y>9999)[-/](?P<m>9{{1,2}})[-/](?P<d>9{{1,2}})(?P<T>[A ]){_CLOCK}(?:[.,](?P<f>9{{1,12}}))?(?: ?{_OFFSET}| (?P<half>AA)| ?(?P<abbr>A{{1,5}}))?",
    rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<T>A)(?P<H>99)(?P<M>99)(?P<S>99)(?:\.(?P<f>9{{1,9}}))?(?:{_OFFSET}|(?P<abbr>A{{1,5}}))?",
    r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<H>99)(?P<M>99)(?P<S>99)\.(?P<f>9{6})(?P<sign>[+-])(?P<ominutes>999)",
    r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<H>99)(?P<M>99)(?P<S>99)",
    rf"(?:A{{3,9}}, )?(?P<d>9{{1,2}}) {_NAMED} (?P<Y>9999) {_CLOCK}(?: {_OFFSET}| (?P<abbr>A{{1,5}}))?",
    rf"\[?(?P<d>99)/{_NAMED}/(?P<Y>9999):{_CLOCK} {_OFFSET}\]?",
    rf"(?P<a>9{{1,2}})(?P<sep>[./-])(?P<b>9{{1,2}})[./-](?P<Y>9999),? {_CLOCK}(?:\.(?P<f>9{{1,9}}))?(?: (?P<half>AA))?",
    r"(?P<number>9{9,19})",
]
_SHAPES = [re.compile(s) for s in SHAPES]
_CLASSES = np.full(128, 0, dtype=np.uint8)
_CLASSES[:] = np.arange(128)
_CLASSES[ord("0") : ord("9") + 1] = ord("9")
_CLASSES[ord("A") : ord("Z") + 1] = ord("A")
_CLASSES[ord("a") : ord("z") + 1] = ord("A")


@dataclass
class ZoneTables:
    """UTC transition seconds and offsets of each zone; ``version`` names the rules they are from, ``years`` the span."""

    version: str
    starts: dict[str, list[int]] = field(default_factory=dict)
    offsets: dict[str, list[int]] = field(default_factory=dict)
    years: tuple[int, int] = YEARS


def known_zones(spark: SparkSession) -> list[str]:
    """The names in the JVM's time-zone rules (about 600)."""
    joined = spark.sparkContext._jvm.java.lang.String.join(",", spark.sparkContext._jvm.java.time.zone.ZoneRulesProvider.getAvailableZoneIds())
    return sorted(joined.split(","))


def zone_tables(spark: SparkSession, zones: Sequence[str], years: tuple[int, int] = YEARS) -> ZoneTables:
    """The transitions of ``zones`` over ``years`` from the JVM's rules. Unknown names are left out."""
    java = spark.sparkContext._jvm.java.time
    out = ZoneTables(version=str(java.zone.ZoneRulesProvider.getVersions("UTC").lastKey()), years=years)
    begin, end = (int(pd.Timestamp(y, 1, 1).timestamp()) for y in (years[0] - 1, years[1] + 2))
    for zone in zones:
        if (out.version, zone, years) in _KNOWN:
            out.starts[zone], out.offsets[zone] = _KNOWN[out.version, zone, years]
            continue
        try:
            rules = java.ZoneId.of(zone).getRules()
        except Exception:  # not a zone of these rules: its local texts denote no instants
            continue
        at = java.Instant.ofEpochSecond(begin)
        starts, offsets = [-(2**62)], [rules.getOffset(at).getTotalSeconds()]
        while (change := rules.nextTransition(at)) is not None and change.toEpochSecond() < end:
            starts.append(change.toEpochSecond())
            offsets.append(change.getOffsetAfter().getTotalSeconds())
            at = change.getInstant()
        out.starts[zone], out.offsets[zone] = _KNOWN[out.version, zone, years] = starts, offsets
    return out


#: Transitions by version of the rules, zone and span; bounded like the zones themselves.
_KNOWN: dict[tuple, tuple[list[int], list[int]]] = {}


def local_to_utc(local: np.ndarray, starts: Sequence[int], offsets: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of local readings to UTC seconds and whether they exist.

    A reading that occurred twice gives the earlier instant; one that was skipped none."""
    begin = np.asarray(starts, dtype=np.int64)
    offset = np.asarray(offsets, dtype=np.int64)
    end = np.append(begin[1:], 2**62)
    first = np.searchsorted(begin, local - 93_600, side="right") - 1  # no offset exceeds 26 hours
    best = np.full(local.shape, np.iinfo(np.int64).max)
    for step in range(3):
        k = np.minimum(first + step, len(begin) - 1)
        utc = local - offset[k]
        fits = (utc >= begin[k]) & (utc < end[k])
        best = np.where(fits & (utc < best), utc, best)
    found = best != np.iinfo(np.int64).max
    return np.where(found, best, 0), found


def shape_masks(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The character matrix of texts (at most ``WIDTH`` long) and their masks as fixed-width bytes."""
    chars = texts.astype(f"U{WIDTH}").view(np.uint32).reshape(len(texts), WIDTH)
    classes = np.where(chars < 128, _CLASSES[np.minimum(chars, 127)], ord("?")).astype(np.uint8)
    return chars, np.ascontiguousarray(classes).view(f"S{WIDTH}").ravel()


_PARSERS: dict[bytes, dict[str, tuple[int, int]] | None] = {}


def parser_of(mask: bytes) -> dict[str, tuple[int, int]] | None:
    """The columns that a mask's texts hold, found once per mask; None when it is no known shape."""
    if mask not in _PARSERS:
        text = mask.decode("ascii")
        hit = next((m for s in _SHAPES if (m := s.fullmatch(text))), None)
        if len(_PARSERS) > 50_000:  # masks of arbitrary dirt must not pile up
            _PARSERS.clear()
        _PARSERS[mask] = None if hit is None else {k: hit.span(k) for k, v in hit.groupdict().items() if v is not None}
    return _PARSERS[mask]


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return np.char.upper(part.view(f"U{span[1] - span[0]}").ravel())


def _lookup(words: np.ndarray, table: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    names, inverse = np.unique(words, return_inverse=True)
    values = np.array([table.get(str(n), -(10**6)) for n in names], dtype=np.int64)[inverse]
    return values, values != -(10**6)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates and whether they exist."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1) & (y <= 9999)
    months = ((np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1).astype("datetime64[M]")
    first = months.astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok & (d <= length)


def _epoch_micros(n: np.ndarray, years: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers to microseconds by the one epoch and unit under which they lie in ``years``."""
    low, high = (int(pd.Timestamp(y, 1, 1).timestamp()) for y in (years[0], years[1] + 1))
    out, found = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=bool)
    for per_second, back in ((1, 0), (10**3, 0), (10**6, 0), (10**9, 0), (10**6, SINCE_1601), (10**7, SINCE_1601), (10**7, SINCE_0001)):
        seconds = n // per_second - back
        here = ~found & (n > 0) & (seconds >= low) & (seconds < high)
        micros = seconds * 10**6 + (n % per_second) * 10**6 // per_second if per_second <= 10**6 else seconds * 10**6 + (n % per_second) // (per_second // 10**6)
        out, found = np.where(here, micros, out), found | here
    return out, found


def _civil(chars, spans, zone, locale, tables: ZoneTables):
    n = len(chars)
    num = lambda k: _number(chars, spans[k])
    ok = np.ones(n, dtype=bool)
    year = num("Y")
    if "a" in spans:
        a, b = num("a"), num("b")
        first = np.isin(locale, MONTH_FIRST) & (chars[:, spans["sep"][0]] == ord("/"))
        month, day = np.where(first, a, b), np.where(first, b, a)
        ok &= np.array([x is not None for x in locale]) | (chars[:, spans["sep"][0]] != ord("/"))
    elif "mon" in spans:
        month, known = _lookup(_words(chars, spans["mon"]), {m: i + 1 for i, m in enumerate(MONTHS)})
        day, ok = num("d"), ok & known
    else:
        month, day = num("m"), num("d")
    if "T" in spans:
        at = chars[:, spans["T"][0]]
        ok &= (at == ord("T")) | (at == ord("t")) | (at == ord(" "))
    days, real = _days(year, month, day)
    hour, minute, second = num("H"), num("M"), num("S")
    ok &= real & (minute < 60) & (second < 60)
    if "half" in spans:
        half = _words(chars, spans["half"])
        ok &= np.isin(half, ("AM", "PM")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.where(half == "PM", 12, 0)
    ok &= hour < 24
    local = days * 86_400 + hour * 3_600 + minute * 60 + second
    micros = np.zeros(n, dtype=np.int64)
    if "f" in spans:
        begin, end = spans["f"]
        kept = min(end, begin + 6)
        micros = _number(chars, (begin, kept)) * 10 ** (6 - (kept - begin))
    if "sign" in spans:
        sign = np.where(chars[:, spans["sign"][0]] == ord("-"), -1, 1)
        if "ominutes" in spans:
            minutes = num("ominutes")
        else:
            minutes = num("oh") * 60 + num("om")
            ok &= num("om") < 60
        utc = local - sign * minutes * 60
        ok &= minutes <= 18 * 60
    elif "abbr" in spans:
        minutes, known = _lookup(_words(chars, spans["abbr"]), ABBREVIATIONS)
        utc, ok = local - minutes * 60, ok & known
    else:
        utc = np.zeros(n, dtype=np.int64)
        exists = np.zeros(n, dtype=bool)
        names = np.array([z if z is not None else "" for z in zone])
        for z in np.unique(names):
            if z in tables.starts:
                here = names == z
                utc[here], exists[here] = local_to_utc(local[here], tables.starts[z], tables.offsets[z])
        ok &= exists
    low, high = (int(pd.Timestamp(y, 1, 1).timestamp()) for y in (tables.years[0], tables.years[1] + 1))
    ok &= (utc >= low) & (utc < high)
    return utc * 10**6 + micros, ok


def to_micros(texts: Sequence[str | None], zones: Sequence[str | None], locales: Sequence[str | None], tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 of each text, and whether it denotes an instant."""
    n = len(texts)
    out, found = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    zones, locales = (np.array([x if isinstance(x, str) else None for x in v], dtype=object) for v in (zones, locales))
    bare = [t.strip(" \t\r\n\0\"'") if isinstance(t, str) else "" for t in texts]
    hexed = [i for i, t in enumerate(bare) if t[:2] in ("0x", "0X") and 3 <= len(t) <= 18]
    if hexed:
        values = np.zeros(len(hexed), dtype=np.int64)
        for j, i in enumerate(hexed):
            try:
                values[j] = min(int(bare[i], 16), 2**63 - 1)
            except ValueError:
                pass
            bare[i] = ""
        out[hexed], found[hexed] = _epoch_micros(values, tables.years)
    rows = np.array([i for i, t in enumerate(bare) if t and len(t) <= WIDTH], dtype=np.int64)
    if not len(rows):
        return out, found
    chars, masks = shape_masks(np.array([bare[i] for i in rows], dtype=object))
    distinct, inverse = np.unique(masks, return_inverse=True)
    for k, mask in enumerate(distinct):
        spans = parser_of(bytes(mask))
        if spans is None:
            continue
        here = np.flatnonzero(inverse == k)
        at = rows[here]
        if "number" in spans:
            texts_here = chars[here]
            wide = spans["number"][1] == 19 and (texts_here[:, 0] == ord("9"))
            values = np.where(wide, 0, _number(texts_here, spans["number"]))
            out[at], found[at] = _epoch_micros(values, tables.years)
        else:
            out[at], found[at] = _civil(chars[here], spans, zones[at], locales[at], tables)
    return out, found


def instant_micros(text: Column, zone: Column, locale: Column, tables: ZoneTables) -> Column:
    """A column of microseconds since 1970, null where the text denotes no instant.

    ``text`` may be null, empty, numeric text or of any length; a text without a zone is a
    local time of ``zone`` (null or unknown: no instant); ``locale`` orders day and month
    in dates with slashes (null: no instant). Finer digits than microseconds are cut off.
    """

    @F.pandas_udf("bigint")
    def convert(t: pd.Series, z: pd.Series, lo: pd.Series) -> pd.Series:
        micros, found = to_micros(t.tolist(), z.tolist(), lo.tolist(), tables)
        return pd.Series(pd.arrays.IntegerArray(micros, ~found))

    return convert(text, zone, locale)


@many_columns()
def normalise_instants(
    rows: DataFrame,
    hosts: DataFrame,
    text: str,
    host: str = "computer",
    zone: str = "time_zone",
    locale: str = "locale_tag",
    out: str = "utc",
    years: tuple[int, int] = YEARS,
    rules: str | None = None,
) -> DataFrame:
    """``rows`` with a timestamp column ``out``: the instant that ``text`` denotes, or null.

    ``hosts`` gives each computer's zone and locale; the first row (by zone, then locale)
    counts where a computer is listed twice. It is joined as the optimiser sees fit, by
    broadcast only under the session's size threshold. Only zones that the JVM's rules know,
    or fixed offsets, travel to the driver, so their number is bounded by the rules; other
    zone texts denote no zone. Blanks, quotes and NULs around a text are cut before its
    length is looked at. Only instants within ``years`` count. ``rules`` names a column to
    add that gives the version of the time-zone rules that were used, so that results of
    different versions can be told apart. All columns of ``rows`` stay.
    """
    spark = rows.sparkSession
    named = hosts.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.min(F.struct(zone, locale)).alias("__z"))
    names = ", ".join(f"'{z}'" for z in known_zones(spark))  # one call instead of one per name
    known = F.expr(f"`{zone}` IN ({names})") | F.col(zone).rlike(FIXED_OFFSET)
    zones = [r[0] for r in hosts.where(known).select(zone).distinct().collect()]
    tables = zone_tables(spark, sorted(zones), years)
    joined = rows.join(named, F.col(host) == F.col("__host"), "left")
    micros = instant_micros(F.col(text).cast("string"), F.col(f"__z.{zone}"), F.col(f"__z.{locale}"), tables)
    done = joined.withColumn(out, F.timestamp_micros(micros)).drop("__host", "__z")
    return done.withColumn(rules, F.lit(tables.version)) if rules else done


def is_canonical_text(text: Column) -> Column:
    """ISO with ``T`` and ``Z`` and either no fraction or exactly six digits."""
    return text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{6})?Z$")


def is_canonical_number(n: Column, years: tuple[int, int] = YEARS) -> Column:
    """Counts of 100 ns since 1601 that lie in ``years``."""
    low, high = ((int(pd.Timestamp(y, 1, 1).timestamp()) + SINCE_1601) * 10**7 for y in (years[0], years[1] + 1))
    return (n >= low) & (n < high)


def utc_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

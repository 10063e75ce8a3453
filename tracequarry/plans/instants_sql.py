"""SQL for the instants of problem 2: each form of timestamp by its regular expression, local readings by zone."""

from __future__ import annotations

import re

from tracequarry.operators.instants import ABBREVIATIONS, MONTH_FIRST, MONTHS, SINCE_0001, SINCE_1601, YEARS

_CLOCK = r"(?P<H>\d{1,2}):(?P<mi>\d\d):(?P<S>\d\d)"
_OFFSET = r"(?P<O>[+-]\d\d:?\d\d)"
#: The forms with a civil date. Groups name their parts.
_FORMS = [
    rf"(?P<Y>\d{{4}})[-/](?P<mo>\d{{1,2}})[-/](?P<d>\d{{1,2}})[Tt ]{_CLOCK}(?:[.,](?P<f>\d{{1,12}}))?(?: ?{_OFFSET}| (?P<half>[AaPp][Mm])| ?(?P<abbr>[A-Za-z]{{1,5}}))?",
    rf"(?P<Y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)[Tt](?P<H>\d\d)(?P<mi>\d\d)(?P<S>\d\d)(?:\.(?P<f>\d{{1,9}}))?(?:{_OFFSET}|(?P<abbr>[A-Za-z]{{1,5}}))?",
    r"(?P<Y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)(?P<H>\d\d)(?P<mi>\d\d)(?P<S>\d\d)\.(?P<f>\d{6})(?P<W>[+-]\d{3})",
    r"(?P<Y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)(?P<H>\d\d)(?P<mi>\d\d)(?P<S>\d\d)",
    rf"(?:[A-Za-z]{{3,9}}, )?(?P<d>\d{{1,2}}) (?P<mon>[A-Za-z]{{3}}) (?P<Y>\d{{4}}) {_CLOCK}(?: {_OFFSET}| (?P<abbr>[A-Za-z]{{1,5}}))?",
    rf"\[?(?P<d>\d\d)/(?P<mon>[A-Za-z]{{3}})/(?P<Y>\d{{4}}):{_CLOCK} {_OFFSET}\]?",
    rf"(?P<a>\d{{1,2}})(?P<sep>[./-])(?P<b>\d{{1,2}})[./-](?P<Y>\d{{4}}),? {_CLOCK}(?:\.(?P<f>\d{{1,9}}))?(?: (?P<half>[AaPp][Mm]))?",
]
_PARTS = ("Y", "mo", "d", "mon", "a", "b", "sep", "H", "mi", "S", "f", "half", "O", "W", "abbr")


def _only(form: str, name: str = "") -> str:
    """A form in which just the named part is a group."""
    return re.sub(r"\(\?P<(\w+)>", lambda m: "(" if m[1] == name else "(?:", form)


def _part(form: str, name: str) -> str:
    """The text of a named part of a form; an empty text where the form has no such part."""
    return f"regexp_extract(t, '^{_only(form, name)}$', 1)" if f"(?P<{name}>" in form else "''"


def found_instants(tables: dict[str, tuple[str, ...]]) -> str:
    """(rec_table, rec_id, fld, utc) of every value that denotes an instant and is not canonical."""
    low, high = (f"epoch(TIMESTAMP '{y}-01-01')::BIGINT" for y in (YEARS[0], YEARS[1] + 1))
    values = []
    for name, columns in tables.items():
        for c in columns:
            if c.endswith("_ft"):
                skip = f"{c} <= 0 OR ({c} >= ({low} + {SINCE_1601}) * 10000000 AND {c} < ({high} + {SINCE_1601}) * 10000000)"
            else:
                skip = rf"regexp_matches({c}, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{{6}})?Z$')"
            values.append(f"SELECT '{name}' AS rec_table, row_id AS rec_id, '{c}' AS fld, computer, CAST({c} AS VARCHAR) AS raw FROM {name} WHERE {c} IS NOT NULL AND NOT ({skip})")
    which = "CASE " + " ".join(f"WHEN regexp_matches(t, '^{_only(f)}$') THEN {i}" for i, f in enumerate(_FORMS)) + " END"
    parts = ", ".join("CASE form " + " ".join(f"WHEN {i} THEN {_part(f, p)}" for i, f in enumerate(_FORMS)) + f" END AS p_{p}" for p in _PARTS)
    months = "CASE upper(p_mon) " + " ".join(f"WHEN '{m}' THEN '{i}'" for i, m in enumerate(MONTHS, 1)) + " END"
    named = "CASE upper(p_abbr) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"
    first = ", ".join(f"'{x}'" for x in MONTH_FIRST)
    number = " ".join(
        f"WHEN n > 0 AND n // {per} - {back} >= {low} AND n // {per} - {back} < {high} THEN (n // {per} - {back}) * 1000000 + {f'(n % {per}) * {10**6 // per}' if per <= 10**6 else f'(n % {per}) // {per // 10**6}'}"
        for per, back in ((1, 0), (10**3, 0), (10**6, 0), (10**9, 0), (10**6, SINCE_1601), (10**7, SINCE_1601), (10**7, SINCE_0001))
    )
    early = " UNION ALL ".join(f"SELECT k, l, time_zone, u - INTERVAL {m} MINUTE AS u FROM zoned" for m in (0, 30, 60, 120))
    return rf"""WITH zones AS (SELECT computer AS c, min(struct_pack(z := time_zone, g := locale_tag)) AS h FROM host_zones WHERE computer IS NOT NULL GROUP BY ALL),
    v AS (SELECT row_number() OVER () AS k, x.*, h.z AS time_zone, h.g AS locale, regexp_replace(raw, '^[ \t\r\n\x00"'']+|[ \t\r\n\x00"'']+$', '', 'g') AS t FROM ({' UNION ALL '.join(values)}) x LEFT JOIN zones ON computer = c),
    shaped AS (SELECT *, CASE WHEN length(t) <= 48 THEN {which} END AS form FROM v),
    parted AS (SELECT *, {parts} FROM shaped WHERE form IS NOT NULL),
    dated AS (SELECT *, try_cast(p_Y AS INT) AS y, try_cast(CASE WHEN p_mon <> '' THEN {months} WHEN p_a <> '' THEN CASE WHEN locale IN ({first}) AND p_sep = '/' THEN p_a ELSE p_b END ELSE p_mo END AS INT) AS mo,
        CAST(CASE WHEN p_a <> '' THEN CASE WHEN locale IN ({first}) AND p_sep = '/' THEN p_b ELSE p_a END ELSE p_d END AS INT) AS d,
        CASE WHEN p_half <> '' THEN CASE WHEN CAST(p_H AS INT) BETWEEN 1 AND 12 THEN CAST(p_H AS INT) % 12 + CASE upper(p_half) WHEN 'PM' THEN 12 ELSE 0 END END ELSE CAST(p_H AS INT) END AS h,
        CAST(p_mi AS INT) AS mi, CAST(p_S AS INT) AS s, CAST(rpad(p_f[1:6], 6, '0') AS BIGINT) AS us FROM parted WHERE NOT (p_sep = '/' AND locale IS NULL)),
    timed AS (SELECT *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) AS TIMESTAMP) AS l FROM dated WHERE h < 24 AND mi < 60 AND s < 60 AND mo IS NOT NULL AND h IS NOT NULL),
    zoned AS (SELECT k, l, time_zone, timezone('UTC', timezone(time_zone, l)) AS u FROM timed WHERE l IS NOT NULL AND p_O = '' AND p_W = '' AND p_abbr = '' AND time_zone IS NOT NULL),
    local AS (SELECT k, min(u) AS u FROM ({early}) WHERE timezone(time_zone, timezone('UTC', u)) = l GROUP BY k),
    shifted AS (SELECT k, CASE WHEN p_O <> '' THEN CASE WHEN CAST(right(p_O, 2) AS INT) < 60 THEN CAST(p_O[1:1] || '1' AS INT) * (CAST(p_O[2:3] AS INT) * 60 + CAST(right(p_O, 2) AS INT)) END
        WHEN p_W <> '' THEN CAST(p_W AS INT) WHEN p_abbr <> '' THEN {named} END AS minutes FROM timed WHERE l IS NOT NULL),
    civil AS (SELECT t.k, epoch_us(coalesce(o.u, t.l - to_minutes(w.minutes))) + us AS micros FROM timed t LEFT JOIN local o ON t.k = o.k LEFT JOIN shifted w ON t.k = w.k AND abs(w.minutes) <= 1080
      WHERE t.l IS NOT NULL AND (o.u IS NOT NULL OR w.minutes IS NOT NULL)),
    counted AS (SELECT k, CASE {number} END AS micros FROM (SELECT k, CASE WHEN regexp_matches(t, '^\d{{9,19}}$') THEN coalesce(try_cast(t AS BIGINT), 0)
        WHEN regexp_matches(t, '^0[xX][0-9a-fA-F]{{1,16}}$') THEN coalesce(try_cast(('0x' || t[3:])::UBIGINT AS BIGINT), 9223372036854775807) END AS n FROM v)),
    every AS (SELECT * FROM civil WHERE micros >= {low} * 1000000 AND micros < {high} * 1000000 UNION ALL SELECT * FROM counted WHERE micros IS NOT NULL)
  SELECT rec_table, rec_id, fld, strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%fZ') AS utc FROM v JOIN every ON v.k = every.k"""

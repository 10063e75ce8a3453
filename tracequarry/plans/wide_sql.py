"""SQL for the cells of problem 1: values typed by regular expressions, the latest usable one of each attribute."""

from __future__ import annotations

from collections.abc import Sequence

from tracequarry.operators.wide import VOID_MARKS, VOID_TYPES, Attribute


def _trim(x: str) -> str:
    return rf"regexp_replace(replace({x}, chr(0), ''), '^\s+|\s+$', '', 'g')"


def _unhex(digits: str) -> str:
    return f"try_cast(('0x' || {digits})::UBIGINT AS BIGINT)"


def _reverse(digits: str) -> str:
    return f"array_to_string(list_reverse(regexp_extract_all({digits}, '[0-9a-f]{{2}}')), '')"


def _hex_digits(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '^(hex(\([0-9a-f]+\))?:|0x)', ''), '[\s,:\-\\]+', '', 'g')"


def _wide_text(digits: str) -> str:
    """The text of UTF-16 bytes, lower half first, given as hex digits."""
    return f"array_to_string(list_transform(regexp_extract_all({digits}, '[0-9a-f]{{4}}'), lambda q: chr(('0x' || q[3:4] || q[1:2])::INT)), '')"


_INT = rf"""CASE WHEN regexp_matches(l, '^[+-]?\d+$') THEN try_cast(l AS BIGINT)
      WHEN regexp_matches(l, '^[+-]?\d{{1,3}}([,'' ]\d{{3}})+$') THEN try_cast(regexp_replace(l, '[,'' ]', '', 'g') AS BIGINT)
      WHEN regexp_matches(l, '^(0x|dword:|qword:)[0-9a-f]{{1,16}}(\s*\(\d+\))?$') THEN {_unhex(r"regexp_extract(l, '^(?:0x|dword:|qword:)([0-9a-f]{1,16})', 1)")}
      WHEN regexp_matches(l, '^hex\((b|4)\):([0-9a-f]{{2}},?){{1,8}}$') THEN {_unhex(_reverse("replace(split_part(l, ':', 2), ',', '')"))}
      WHEN regexp_matches(l, '^hex\(5\):([0-9a-f]{{2}},?){{1,8}}$') THEN {_unhex("replace(split_part(l, ':', 2), ',', '')")} END"""
_TIME = r"""coalesce(
      CASE WHEN regexp_matches(t, '^\d{14}$') THEN try_strptime(t, '%Y%m%d%H%M%S') END,
      CASE WHEN regexp_matches(t, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?Z?$') THEN try_strptime(replace(t[1:19], 'T', ' '), '%Y-%m-%d %H:%M:%S') END,
      CASE WHEN regexp_matches(t, '^\d{4}-\d\d-\d\d$') THEN try_strptime(t, '%Y-%m-%d') END,
      CASE WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(t, '%m/%d/%Y') END,
      CASE WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d$') THEN try_strptime(t, '%m/%d/%Y %H:%M:%S') END,
      CASE WHEN regexp_matches(upper(t), '^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d [AP]M$') THEN try_strptime(upper(t), '%m/%d/%Y %I:%M:%S %p') END)"""


def found_cells(attributes: Sequence[Attribute]) -> str:
    """(key_id, attr, cell) of every filled cell."""
    names = ", ".join(f"('{a.name.lower()}', '{a.name}', '{a.kind}')" for a in attributes)
    marks = ", ".join(f"'{m}'" for m in VOID_MARKS)
    types = ", ".join(f"'{k}'" for k in VOID_TYPES)
    items = rf"""CASE WHEN starts_with(w, '[') AND json_valid(w) AND json_type(w::JSON) = 'ARRAY' THEN from_json(w::JSON, '["VARCHAR"]')
      WHEN starts_with(lower(w), 'hex(7):') AND regexp_matches({_hex_digits('w')}, '^([0-9a-f]{{2}})+$') THEN regexp_split_to_array({_wide_text(_hex_digits('w'))}, '[\x00\r\n]+')
      ELSE regexp_split_to_array(d, '[\x00\r\n]+') END"""
    kept = rf"list_filter(list_transform({items}, lambda i: regexp_replace(i, '^\s+|\s+$', '', 'g')), lambda i: i IS NOT NULL AND i <> '')"
    text = rf"CASE WHEN regexp_matches(l, '^hex\([12]\):') AND regexp_matches({_hex_digits('t')}, '^([0-9a-f]{{2}})+$') THEN {_trim(_wide_text(_hex_digits('t')))} ELSE t END"
    return rf"""WITH wanted(k, attr, kind) AS (VALUES {names}),
    v AS (SELECT key_id, w.attr, w.kind, value_data AS d, {_trim('value_data')} AS t, regexp_replace(value_data, '^\s+|\s+$', '', 'g') AS w, collected_at, row_id
      FROM reg_values r JOIN wanted w ON lower(regexp_replace(replace(value_name, chr(0), ''), '^[\s"'']+|[\s"'']+$', '', 'g')) = w.k
      WHERE key_id IS NOT NULL AND value_data IS NOT NULL AND regexp_matches(key_path, '(^|\\)(InventoryApplicationFile|InventoryApplication|Services)(\\|$)', 'i')
        AND NOT coalesce(lower(trim(value_type)) IN ({types}), false)),
    u AS (SELECT *, lower(t) AS l FROM v WHERE lower(t) NOT IN ({marks})),
    c AS (SELECT key_id, attr, collected_at, row_id, CASE kind
        WHEN 'int' THEN CAST({_INT} AS VARCHAR)
        WHEN 'datetime' THEN strftime({_TIME}, '%Y-%m-%dT%H:%M:%S')
        WHEN 'list' THEN nullif(array_to_string({kept}, '|'), '')
        WHEN 'bytes' THEN CASE WHEN regexp_matches({_hex_digits('t')}, '^([0-9a-f]{{2}})+$') THEN {_hex_digits('t')} END
        ELSE nullif({text}, '') END AS cell FROM u)
  SELECT key_id, attr, arg_max(cell, struct_pack(a := coalesce(collected_at, TIMESTAMP '0001-01-01'), b := row_id)) AS cell FROM c WHERE cell IS NOT NULL GROUP BY key_id, attr"""

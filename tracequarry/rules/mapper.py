"""Field mapping: renamed, cast and extracted columns, and mapping files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.rules.compile import TypedFields
from tracequarry.rules.ir import And, Const, Node
from tracequarry.rules.parse import Container, FieldSpec, Rule, RuleError, parse_field, parse_filter, rule_files


def cast_value(text: Column, cast: str) -> Column:
    """A text's leading number as text of that number; where there is none the original stays."""
    if cast == "int":
        return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint").cast("string"), text)
    if cast == "flt":
        return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double").cast("string"), text)
    return text


def container_value(text: Column, container: Container, key: str) -> Column:
    """The value of ``key`` in a payload: a top-level JSON member, or the first pair of that name."""
    if container.format == "json":
        return F.get_json_object(text, "$['" + key.replace("'", "\\'") + "']")
    quoted = lambda s: "\\Q" + s + "\\E"
    items = F.split(text, quoted(container.delimiter)) if container.delimiter else F.array(text)
    if container.trim:
        items = F.transform(items, lambda x: F.trim(x))
    hit = F.filter(items, lambda x: x.startswith(key + container.separator))
    return F.when(F.size(hit) > 0, F.substring(hit[0], len(key + container.separator) + 1, F.length(hit[0])))


def map_fields(df: DataFrame, specs: list[FieldSpec] | tuple[FieldSpec, ...], keep: list[str] | None = None) -> DataFrame:
    """The visible fields of ``specs`` (read at their ``to`` paths) under their names, after the columns to ``keep``.

    A missing source gives null. With casts all mapped fields are texts, as rules see them."""
    found = TypedFields(df.schema)
    out = [F.col(f"`{c}`") for c in (keep or [])]
    for s in specs:
        if not s.visible:
            continue
        if s.container:
            value = container_value(found.value(s.container.field)[0].cast("string"), s.container, s.to)
        else:
            column, kind = found.value(s.to)
            value = column
            if s.cast is not None:
                text = F.when(column.isNotNull(), F.format_string("%.6f", column)) if s.cast == "str" and isinstance(kind, (T.DoubleType, T.FloatType)) else column.cast("string")
                value = cast_value(text, s.cast)
        out.append(value.alias(s.name))
    return df.select(*out)


@dataclass(frozen=True)
class Group:
    name: str
    timestamp: str
    filter: Node
    fields: tuple[FieldSpec, ...] = ()


@dataclass(frozen=True)
class Mapping:
    """How the rules of one engine apply to documents of one kind."""

    kind: str
    rules: str
    groups: tuple[Group, ...]
    exclusions: frozenset[str] = frozenset()
    preconditions: tuple[tuple[tuple[tuple[str, str], ...], Node], ...] = ()


def parse_mapping(spec: dict) -> Mapping:
    if "kind" not in spec or "rules" not in spec or not spec.get("groups"):
        raise RuleError("a mapping needs kind, rules and groups")
    groups = tuple(
        sorted((Group(str(g["name"]), str(g["timestamp"]), parse_filter(g["filter"]), tuple(parse_field(f) for f in g.get("fields", ()))) for g in spec["groups"]), key=lambda g: g.name)
    )
    conditions = (spec.get("extensions") or {}).get("preconditions") or []
    pre = tuple((tuple((str(k), str(v)) for k, v in p["for"].items()), parse_filter(p["filter"])) for p in conditions)
    kind = "json" if spec["kind"] == "jsonl" else str(spec["kind"])
    return Mapping(kind, str(spec["rules"]), groups, frozenset(map(str, spec.get("exclusions") or ())), pre)


def load_mappings(path: str | Path) -> list[Mapping]:
    import yaml

    return [parse_mapping(d) for f in rule_files(path) for d in yaml.safe_load_all(f.read_text(encoding="utf-8")) if d]


def precondition(mapping: Mapping, rule: Rule) -> Node:
    """The extra filter of the first precondition whose metadata a rule has; else true."""
    meta = {"name": rule.name, "title": rule.name, "level": rule.level, "status": rule.status, **{k: v for k, v in rule.meta.items() if not isinstance(v, dict)}}
    for k, v in rule.meta.items():
        if isinstance(v, dict):
            meta |= {f"{k}.{a}": b for a, b in v.items()}
    for wanted, expression in mapping.preconditions:
        if all(str(meta.get(k)) == v for k, v in wanted):
            return expression
    return Const(True)


def bind(rules: list[Rule], mappings: list[Mapping]) -> list[tuple[Rule, Group | None, Node, str]]:
    """(rule, group, whole expression, kind): native rules as they are, others once per mapping group."""
    out: list[tuple[Rule, Group | None, Node, str]] = []
    for r in sorted(rules, key=lambda r: r.name):
        if r.engine == "native":
            out.append((r, None, r.expression, "json" if r.kind == "jsonl" else r.kind))
            continue
        for m in mappings:
            if m.rules == r.engine and r.name not in m.exclusions:
                out += [(r, g, And((g.filter, precondition(m, r), r.expression)), m.kind) for g in m.groups]
    return out

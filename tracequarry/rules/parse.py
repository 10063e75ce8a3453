"""Texts and YAML to expressions: ``key: value`` terms, identifier values, conditions, native rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from tracequarry.rules.compile import portable_regex
from tracequarry.rules.ir import And, AtLeast, CastOk, Compare, Const, Exists, Nested, Node, Not, Null, Number, Or, Ref, Text
from tracequarry.rules.optimize import optimize

LEVELS = ("critical", "high", "medium", "low", "info")
STATUSES = ("stable", "experimental")


@dataclass(frozen=True)
class Container:
    """A payload embedded in a field: JSON text, or pairs cut by ``delimiter`` and ``separator``."""

    field: str
    format: str
    delimiter: str = ""
    separator: str = ""
    trim: bool = False


@dataclass(frozen=True)
class FieldSpec:
    """A column of a rule's result: source field, name, cast or container, whether it is shown."""

    name: str
    source: str
    to: str
    cast: str | None = None
    container: Container | None = None
    visible: bool = True


@dataclass(frozen=True)
class Aggregate:
    op: str
    n: int
    fields: tuple[str, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    group: str
    kind: str
    level: str
    status: str
    expression: Node
    timestamp: str = "timestamp"
    fields: tuple[FieldSpec, ...] = ()
    aggregate: Aggregate | None = None
    description: str = ""
    authors: tuple[str, ...] = ()
    engine: str = "native"
    meta: dict = field(default_factory=dict, hash=False)


class RuleError(ValueError):
    """A rule that cannot be loaded, with the reason."""


_NUMERIC = re.compile(r"^\s*(>=|<=|==|=|>|<)?\s*([+-]?\d+(?:\.\d+)?)\s*$")
_WRAPPED = re.compile(r"^(int|flt|str|not|all)\((.*)\)$")


def parse_numeric(text: str) -> tuple[str, float] | None:
    """(operator, number) of ``n``, ``=n``, ``>n``, ``>=n``, ``<n`` or ``<=n``."""
    m = _NUMERIC.match(text)
    return (m[1].replace("==", "=").replace("=", "==") if m[1] in ("=", "==") else (m[1] or "=="), float(m[2])) if m else None


def text_test(path: str, value: str, marker: bool = True) -> Node:
    """``i`` (any letter case), ``?regex``, ``*x*``, ``*x``, ``x*`` or the exact text."""
    ignore = False
    if marker and value[:1] == "i" and len(value) > 1:
        ignore, value = True, value[1:]
    if value.startswith("?"):
        return Text(path, "regex", portable_regex(value[1:]), ignore)
    if value == "*":
        return Exists(path)
    if len(value) > 1 and value.startswith("*") and value.endswith("*"):
        return Text(path, "contains", value[1:-1], ignore)
    if value.startswith("*"):
        return Text(path, "endswith", value[1:], ignore)
    if value.endswith("*"):
        return Text(path, "startswith", value[:-1], ignore)
    return Text(path, "exact", value, ignore)


def value_test(path: str, value, cast: str | None = None) -> Node:
    """The test that one YAML value stands for."""
    if value is None:
        return Text(path, "exact", "")
    if isinstance(value, bool):
        return Text(path, "exact", str(value).lower())
    if isinstance(value, (int, float)):
        return Text(path, "exact", str(value)) if cast == "str" else Compare(path, "==", value, isinstance(value, int))
    if isinstance(value, list):
        return Or(tuple(value_test(path, v, cast) for v in value))
    if isinstance(value, dict):
        return Nested(path, And(tuple(key_test(k, v) for k, v in value.items())))
    text = str(value)
    numeric = None if cast == "str" else parse_numeric(text)
    if numeric and (cast in ("int", "flt") or not text.strip()[:1].isdigit() or "." not in text):
        return Compare(path, numeric[0], numeric[1], numeric[1].is_integer())
    return text_test(path, text)


def key_test(key: str, value) -> Node:
    """One ``key: value`` entry of a block; the key may be ``int(f)``, ``str(f)``, ``flt(f)``, ``not(f)`` or ``all(f)``."""
    m = _WRAPPED.match(key.strip())
    if not m:
        return value_test(key.strip(), value)
    how, inner = m.groups()
    if how == "not":
        return Not(key_test(inner, value))
    if how == "all":
        return And(tuple(key_test(inner, v) for v in (value if isinstance(value, list) else [value])))
    if value is None or value == "*":
        return CastOk(how, inner)
    return value_test(inner, value, how)


def parse_block(block) -> Node:
    """A mapping is an AND over its keys, a list an OR over its mappings."""
    if isinstance(block, list):
        return Or(tuple(parse_block(x) for x in block))
    if not isinstance(block, dict):
        raise RuleError(f"a block must be a mapping, not {block!r}")
    return And(tuple(key_test(str(k), v) for k, v in block.items()))


def parse_kv(text: str) -> Node:
    """A command-line term ``key: value``; ``!value`` negates; a leading ``i`` marks any letter case."""
    key, sep, value = text.partition(": ")
    if not sep:
        raise RuleError(f"expected 'key: value', got {text!r}")
    value = value.strip()
    if value.startswith("!"):
        return Not(parse_kv(f"{key}: {value[1:]}"))
    m = _WRAPPED.match(key.strip())
    if m and m[1] == "not":
        return Not(parse_kv(f"{m[2]}: {value}"))
    cast, path = (m[1], m[2]) if m else (None, key.strip())
    numeric = None if cast == "str" else parse_numeric(value)
    if numeric:
        return Compare(path, numeric[0], numeric[1], numeric[1].is_integer())
    return text_test(path, value, marker=bool(re.match(r"^i[*?A-Za-z0-9]", value)))


_TOKEN = re.compile(r"\s*(\(|\)|,|[^\s(),]+)")


def parse_condition(text: str, names: set[str]) -> Node:
    """``or`` under ``and`` under ``not``; brackets; ``all(x)``, ``of(x, n)``; an empty text is true."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return Const(True)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(wanted: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (wanted is not None and tokens[at] != wanted):
            raise RuleError(f"expected {wanted or 'more'} in the condition {text!r}")
        at += 1
        return tokens[at - 1]

    def either() -> Node:
        items = [both()]
        while peek() == "or":
            take()
            items.append(both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both() -> Node:
        items = [negated()]
        while peek() == "and":
            take()
            items.append(negated())
        return items[0] if len(items) == 1 else And(tuple(items))

    def negated() -> Node:
        if peek() == "not":
            take()
            return Not(negated())
        return single()

    def single() -> Node:
        token = take()
        if token == "(":
            inside = either()
            take(")")
            return inside
        if token in ("all", "of") and peek() == "(":
            take("(")
            name = take()
            n = None
            if token == "of":
                take(",")
                n = int(take())
            take(")")
            refs = tuple(Ref(x) for x in sorted(names) if x == name or x.startswith(name + "_"))
            return And(refs) if n is None else AtLeast(n, refs)
        if token in (")", ",", "and", "or"):
            raise RuleError(f"unexpected {token!r} in the condition {text!r}")
        if token not in names:  # literals, unless a block has such a name
            if token in ("true", "false"):
                return Const(token == "true")
            if token == "null":
                return Null()
            if re.fullmatch(r"[+-]?\d+(\.\d+)?", token):
                return Number(float(token))
        return Ref(token)

    out = either()
    if at != len(tokens):
        raise RuleError(f"left over in the condition {text!r}: {' '.join(tokens[at:])}")
    return out


def parse_filter(spec) -> Node:
    """A mapping with ``condition`` and named blocks, a mapping of keys, or a scalar ``key: value`` term."""
    if isinstance(spec, str):
        return optimize(parse_kv(spec))
    if not isinstance(spec, dict):
        raise RuleError("a filter must be a mapping or a text")
    if "condition" not in spec:
        return optimize(parse_block(spec))
    blocks = {str(k): parse_block(v) for k, v in spec.items() if k != "condition"}
    return optimize(parse_condition(str(spec["condition"]), set(blocks)), blocks)


def parse_field(spec: dict) -> FieldSpec:
    """``name``, ``from``, ``to`` (perhaps ``int(x)``), ``visible`` and ``container``; short forms allowed."""
    name = spec.get("name") or spec.get("to") or spec.get("from")
    if not name:
        raise RuleError("a field needs a name")
    source, to = str(spec.get("from", name)), str(spec.get("to", spec.get("from", name)))
    m = re.match(r"^(int|str|flt)\((.*)\)$", to)
    cast, to = (m[1], m[2]) if m else (None, to)
    container = None
    if spec.get("container"):
        if cast:
            raise RuleError("a field has either a cast or a container")
        c = spec["container"]
        container = Container(str(c["field"]), str(c["format"]), str(c.get("delimiter", "")), str(c.get("separator", "")), bool(c.get("trim", False)))
        if container.format not in ("json", "kv"):
            raise RuleError(f"unknown container format: {container.format}")
    return FieldSpec(str(name), source, to, cast, container, bool(spec.get("visible", True)))


def parse_aggregate(spec: dict) -> Aggregate:
    got = parse_numeric(str(spec.get("count", "")))
    op, n = got if got else ("==", 1.0)
    return Aggregate(op, int(n), tuple(str(f) for f in spec.get("fields", ())), bool(spec.get("distinct", False)))


def parse_rule(spec: dict) -> Rule:
    """A native rule from its YAML mapping."""
    name = spec.get("name") or spec.get("title")
    for key in ("group", "kind", "level", "status", "filter"):
        if key not in spec:
            raise RuleError(f"rule {name!r} lacks {key}")
    if spec["level"] not in LEVELS or spec["status"] not in STATUSES:
        raise RuleError(f"rule {name!r} has an unknown level or status")
    aggregate = parse_aggregate(spec["aggregate"]) if spec.get("aggregate") else None
    return Rule(
        str(name), str(spec["group"]), str(spec["kind"]), spec["level"], spec["status"], parse_filter(spec["filter"]), str(spec.get("timestamp", "timestamp")),
        tuple(parse_field(f) for f in spec.get("fields", ())), aggregate, str(spec.get("description", "")), tuple(spec.get("authors", ())),
    )


def rule_files(path: str | Path) -> list[Path]:
    """The YAML files at a path, in order."""
    p = Path(path)
    if p.is_dir():
        return sorted(x for x in p.rglob("*") if x.suffix in (".yml", ".yaml"))
    if p.suffix not in (".yml", ".yaml"):
        raise RuleError(f"not a rule file: {path}")
    return [p]


def load_patterns(path: str | Path) -> list[str]:
    """The patterns of a file, one a line; blank lines and those that begin with ``#`` are left out."""
    lines = (line.rstrip("\r\n") for line in Path(path).read_text(encoding="utf-8").split("\n"))
    return [portable_regex(line) for line in lines if line.strip() and not line.startswith("#")]


def load_rules(path: str | Path, engine: str = "native", kinds=None, levels=None, statuses=None) -> list[Rule]:
    """All rules under a path, sorted by name, of the wanted kinds, levels and statuses."""
    import yaml

    from tracequarry.rules import sigma

    out: list[Rule] = []
    for f in rule_files(path):
        text = f.read_text(encoding="utf-8")
        out += sigma.load(text) if engine == "sigma" else [parse_rule(d) for d in yaml.safe_load_all(text) if d]
    keep = lambda r: (not kinds or r.kind in kinds) and (not levels or r.level in levels) and (not statuses or r.status in statuses)
    return sorted(filter(keep, out), key=lambda r: r.name)


def lint(path: str | Path, engine: str = "native") -> list[tuple[str, str | None, list[str]]]:
    """(file, error or None, expressions) of every rule file under a path."""
    from tracequarry.rules.ir import show

    out = []
    for f in rule_files(path):
        try:
            out.append((str(f), None, [show(r.expression) for r in load_rules(f, engine)]))
        except Exception as e:  # any fault of a rule file is what is asked for
            out.append((str(f), f"{type(e).__name__}: {e}", []))
    return out

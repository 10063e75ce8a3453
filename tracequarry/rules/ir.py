"""The rule expression tree: plain data, evaluated only as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class AtLeast:
    """True when at least ``n`` of the items are."""

    n: int
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Number:
    """A number standing alone as a test: true."""

    value: float


@dataclass(frozen=True)
class Null:
    """Null standing alone as a test: false."""


@dataclass(frozen=True)
class Ref:
    """A named block of the same detection."""

    name: str


@dataclass(frozen=True)
class Exists:
    """The field is present and not null."""

    path: str


@dataclass(frozen=True)
class CastOk:
    """The field is present and can be read as ``int``, ``flt`` or ``str``."""

    kind: str
    path: str


@dataclass(frozen=True)
class Compare:
    """Numeric comparison of a field; texts count by their leading number."""

    path: str
    op: str
    value: float
    whole: bool = False


@dataclass(frozen=True)
class Text:
    """Text test: how is exact, contains, startswith, endswith or regex. Arrays: any element."""

    path: str
    how: str
    value: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Nested:
    """The field is an object and the item holds inside it."""

    path: str
    item: object


@dataclass(frozen=True)
class Matrix:
    """Any row of patterns all of which match their fields."""

    paths: tuple
    rows: tuple


Node = object


def children(node: Node) -> tuple:
    if isinstance(node, (And, Or, AtLeast)):
        return node.items
    if isinstance(node, (Not, Nested)):
        return (node.item,)
    return ()


def rebuild(node: Node, change: Callable[[Node], Node]) -> Node:
    """The node with every child changed."""
    if isinstance(node, (And, Or, AtLeast)):
        return replace(node, items=tuple(change(x) for x in node.items))
    if isinstance(node, (Not, Nested)):
        return replace(node, item=change(node.item))
    return node


def fields(node: Node, prefix: str = "") -> set[str]:
    """All field paths that an expression reads."""
    here = prefix + "." if prefix else ""
    if isinstance(node, Nested):
        return {here + node.path} | fields(node.item, here + node.path)
    if isinstance(node, Matrix):
        return {here + p for p in node.paths}
    own = {here + node.path} if hasattr(node, "path") else set()
    return own.union(*(fields(c, prefix) for c in children(node))) if children(node) else own


def rename(node: Node, names: dict[str, str]) -> Node:
    """The expression over renamed fields."""
    if isinstance(node, Matrix):
        return replace(node, paths=tuple(names.get(p, p) for p in node.paths))
    if hasattr(node, "path"):
        node = replace(node, path=names.get(node.path, node.path))
        if isinstance(node, Nested):
            return node
    return rebuild(node, lambda c: rename(c, names))


def show(node: Node) -> str:
    """One line of readable text for an expression."""
    match node:
        case And(items):
            return "(" + " and ".join(map(show, items)) + ")" if items else "true"
        case Or(items):
            return "(" + " or ".join(map(show, items)) + ")" if items else "false"
        case AtLeast(n, items):
            return f"of({', '.join(map(show, items))}; {n})"
        case Not(item):
            return f"not {show(item)}"
        case Const(value):
            return str(value).lower()
        case Number(value):
            return f"{value:g}"
        case Null():
            return "null"
        case Ref(name):
            return name
        case Exists(path):
            return f"exists {path}"
        case CastOk(kind, path):
            return f"{kind}({path})"
        case Compare(path, op, value, _):
            return f"{path} {op} {value:g}"
        case Text(path, how, value, ignore):
            return f"{path} {how}{' (any case)' if ignore else ''} {value!r}"
        case Nested(path, item):
            return f"{path}.{{{show(item)}}}"
        case Matrix(paths, rows):
            return f"matrix({', '.join(paths)}: {len(rows)} rows)"
    raise TypeError(f"not an expression: {node!r}")

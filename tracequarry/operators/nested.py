"""Deeply nested JSON records to related flat tables (problem 5).

Shared inlining. A first pass analyses the schema graph of all records: which paths hold
objects, arrays of objects (also written as one bare object or as JSON text) and scalars.
Paths that are repeated anywhere become relations; objects that occur at most once per
parent are inlined into the relation above them as dotted columns. An element that hangs
under several parents (shared) or under itself (recursive) has one relation for all its
places, whose rows name the parent's path as part of the foreign key. The second pass shreds
every record into rows (path, record id, ordinals, parent path and ordinals, inlined columns).

Records may be nested to any depth: nothing here recurses. What travels to the driver is the
schema graph alone, and that is bounded however odd the records: an object with more than
``MAP_KEYS`` different member names (GUIDs or users as names) is a map, whose members are one
repeated element ``*``; and a name that holds itself more than ``SELF_HELD`` times over is
followed by going round, not deeper.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different member names of the objects at one path from which they are the keys of a map.
MAP_KEYS = 1_000
#: How often a name may occur in a path; the path of a further occurrence is that of the last one.
SELF_HELD = 2
#: Joined paths kept per worker.
KEPT_PATHS = 200_000
#: Name of a map's members in paths, and of the column with a member's name.
MEMBER, KEY = "*", "@key"


def _refuse(name: str):
    raise ValueError(f"not JSON: {name}")


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The value of strict JSON nested to any depth, with a stack of its own."""
    root: list = []
    stack: list = [root]
    names: list = [None]
    at, end = 0, len(text)
    expect = "value"  # value, first (value or end), name, first_name (name or end), next (comma or end)

    def put(value):
        holder = stack[-1]
        if isinstance(holder, dict):
            holder[names[-1]] = value
        else:
            holder.append(value)

    while True:
        at = _BLANK.match(text, at).end()
        if at == end:
            break
        ch = text[at]
        if expect in ("value", "first"):
            if expect == "first" and ch == "]":
                stack.pop()
                names.pop()
                at, expect = at + 1, "next"
            elif ch in "[{":
                value: list | dict = [] if ch == "[" else {}
                put(value)
                stack.append(value)
                names.append(None)
                at, expect = at + 1, "first" if ch == "[" else "first_name"
            elif ch == '"':
                value, at = scanstring(text, at + 1, True)
                put(value)
                expect = "next"
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise ValueError(f"not JSON at {at}")
                put(_WORDS[m[0]] if m[0] in _WORDS else float(m[0]) if m[2] or m[3] else int(m[0]))
                at, expect = m.end(), "next"
        elif expect in ("name", "first_name"):
            if expect == "first_name" and ch == "}":
                stack.pop()
                names.pop()
                at, expect = at + 1, "next"
                continue
            if ch != '"':
                raise ValueError(f"not JSON at {at}")
            names[-1], at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"not JSON at {at}")
            at, expect = at + 1, "value"
        else:
            if len(stack) == 1:
                raise ValueError(f"more than one value at {at}")
            inside = isinstance(stack[-1], dict)
            if ch == ",":
                at, expect = at + 1, "name" if inside else "value"
            elif ch == ("}" if inside else "]"):
                stack.pop()
                names.pop()
                at += 1
            else:
                raise ValueError(f"not JSON at {at}")
    if len(stack) != 1 or len(root) != 1 or expect != "next":
        raise ValueError("incomplete JSON")
    return root[0]


def parse(text: str | None):
    """(value, True) of strict JSON, else (None, False). Duplicate names: the last counts."""
    if text is None:
        return None, False
    try:
        return json.loads(text, parse_constant=_refuse), True
    except RecursionError:
        pass
    except ValueError:
        return None, False
    try:
        return parse_deep(text), True
    except ValueError:
        return None, False


def as_array(value):
    """The array that a value stands for: itself, parsed JSON text, or the one object; else None."""
    if isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("[", "{"):
            return None
        value, ok = parse(value)
        if not ok:
            return None
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else None


def _stringified_array(value) -> list | None:
    return as_array(value) if isinstance(value, list) or (isinstance(value, str) and value.lstrip()[:1] == "[") else None


def _scalar(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(2**63) <= value < 2**63 else "double"
    return "double" if isinstance(value, float) else "string"


class Paths:
    """Joins names to paths, with maps and elements that hold themselves taken into account."""

    def __init__(self, maps: Iterable[str] = ()):
        self.maps = set(maps)
        self.kept: dict[tuple[str, str], str] = {}

    def join(self, path: str, name: str) -> str:
        found = self.kept.get((path, name))
        if found is None:
            if len(self.kept) >= KEPT_PATHS:
                self.kept.clear()
            found = self.kept[path, name] = self._joined(path, MEMBER if path in self.maps else name)
        return found

    @staticmethod
    def _joined(path: str, name: str) -> str:
        if not path:
            return name
        parts = path.split(".")
        if name != MEMBER and parts.count(name) >= SELF_HELD:
            return ".".join(parts[: len(parts) - parts[::-1].index(name)])
        return f"{path}.{name}"


class Facts:
    """(path, fact) pairs of a schema, in which objects with too many member names turn into maps."""

    def __init__(self):
        self.paths = Paths()
        self.pairs: set[tuple[str, str]] = set()
        self.members: dict[str, set[str]] = {}

    def child(self, path: str, name: str) -> str:
        joined = self.paths.join(path, name)
        if path not in self.paths.maps:
            known = self.members.setdefault(path, set())
            if name not in known:
                known.add(name)
                if len(known) > MAP_KEYS:
                    self.make_map(path)
                    joined = self.paths.join(path, name)
        return joined

    def make_map(self, path: str) -> None:
        """The objects at ``path`` are maps from now on; facts below are renamed."""
        self.paths.maps.add(path)
        self.paths.kept.clear()
        inside = path + "." if path else ""
        moved = {(p, f) for p, f in self.pairs if p.startswith(inside) and p != path}
        self.pairs -= moved
        self.pairs |= {(self._renamed(p), f) for p, f in moved} | {(path, "map")}
        for p in [p for p in self.members if p == path or p.startswith(inside)]:
            names = self.members.pop(p)
            if p != path:
                self.members.setdefault(self._renamed(p), set()).update(names)

    def _renamed(self, path: str) -> str:
        out = ""
        for part in path.split("."):
            part = MEMBER if out in self.paths.maps else part
            out = f"{out}.{part}" if out else part
        return out

    def add(self, value, root: str) -> None:
        """Adds what one record shows; a fact is ``array``, ``object``, ``map`` or a scalar type."""
        todo = [(value, root)]
        while todo:
            value, path = todo.pop()
            items = _stringified_array(value)
            if items is not None and any(isinstance(x, dict) for x in items):
                self.pairs.add((path, "array"))
                objects = [x for x in items if isinstance(x, dict)]
            elif isinstance(value, dict):
                self.pairs.add((path, "object"))
                objects = [value]
            else:
                if value is not None and path:
                    self.pairs.add((path, "string" if isinstance(value, list) else _scalar(value)))
                continue
            for x in objects:
                todo += [(v, self.child(path, k)) for k, v in x.items()]

    def merge(self, path: str, fact: str) -> None:
        """Adds a fact that another task found."""
        if fact == "map":
            if path not in self.paths.maps:
                self.make_map(path)
            return
        at = ""
        for part in path.split(".") if path else ():
            at = self.child(at, part)
        self.pairs.add((at, fact))


@dataclass
class SchemaGraph:
    """Paths of the relations, their parents, and each relation's inlined columns with types.

    ``relation_of`` names the relation that a path's rows belong to: the path itself, or the
    element's name where it is shared or recursive."""

    relations: list[str]
    parent: dict[str, str] = field(default_factory=dict)
    columns: dict[str, dict[str, str]] = field(default_factory=dict)
    shared: dict[str, list[str]] = field(default_factory=dict)
    recursive: list[str] = field(default_factory=list)
    relation_of: dict[str, str] = field(default_factory=dict)
    maps: frozenset[str] = frozenset()


def analyse(records: DataFrame, column: str, root: str = "", declared: Sequence[str] = ()) -> SchemaGraph:
    """The schema graph of all records' JSON; ``declared`` paths count as repeated in any case.

    With ``root`` the outermost array is itself a relation of that name. Invalid records,
    nulls and empty texts add nothing; an empty table gives just the declared relations."""

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        facts = Facts()
        for b in batches:
            for text in b.column(0).to_pylist():
                value, ok = parse(text)
                if ok:
                    facts.add(value, root)
        pairs = sorted(facts.pairs)
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in pairs], pa.string()), "fact": pa.array([f for _, f in pairs], pa.string())})

    found = records.select(F.col(column)).mapInArrow(scan, "path string, fact string").distinct()
    merged = Facts()
    for path, fact in found.toLocalIterator():  # one partition at a time into a graph of bounded size
        merged.merge(path, fact)
    return build_graph(sorted(merged.pairs), root, declared)


def build_graph(facts: Sequence[tuple[str, str]], root: str = "", declared: Sequence[str] = ()) -> SchemaGraph:
    objects = {p for p, f in facts if f in ("array", "object")}
    maps = frozenset(p for p, f in facts if f == "map")
    members = {f"{p}.{MEMBER}" if p else MEMBER for p in maps}
    repeated = {p for p, f in facts if f == "array" and p} | set(declared) | ({root} if root else set()) | (members & objects)
    graph = SchemaGraph(sorted(repeated), maps=maps)

    def above(path: str, among) -> str:
        while path:
            path = path.rpartition(".")[0]
            if path in among:
                return path
        return ""

    for r in graph.relations:
        graph.parent[r] = above(r, repeated)
        name = r.rpartition(".")[2]
        if name != MEMBER:
            graph.shared.setdefault(name, []).append(r)
            if name in r.split(".")[:-1]:
                graph.recursive.append(r)
    graph.shared = {k: v for k, v in graph.shared.items() if len(v) > 1}
    graph.relation_of = {r: r.rpartition(".")[2] if r.rpartition(".")[2] in graph.shared else r for r in graph.relations}
    kinds: dict[str, dict[str, set[str]]] = {}
    flat_maps = {p for p in maps if (f"{p}.{MEMBER}" if p else MEMBER) not in repeated}
    for path, fact in facts:
        inside = above(path, flat_maps)
        if inside or "" in flat_maps:
            path, fact = inside, "string"  # a map of scalars is one column of JSON text
        if fact not in ("array", "object", "map") and path not in repeated and path:
            owner = above(path, repeated)
            local = path[len(owner) + 1 :] if owner else path
            kinds.setdefault(graph.relation_of.get(owner, owner), {}).setdefault(local, set()).add(fact)
    for owner, columns in kinds.items():
        for local, seen in columns.items():
            graph.columns.setdefault(owner, {})[local] = next(iter(seen)) if len(seen) == 1 else "double" if seen == {"bigint", "double"} else "string"
    for p in members & repeated:
        graph.columns.setdefault(graph.relation_of[p], {})[KEY] = "string"
    return graph


def shred_record(value, relations: set[str], prefixes: set[str], root: str, paths: Paths, emit: Callable) -> None:
    """Calls ``emit(path, ordinals, parent path, parent ordinals, element, key)`` for every object in a relation.

    ``prefixes`` holds every path above a relation; other branches are not entered."""
    if root and root in relations:
        todo = [(root, value, (), "", True)]
    elif isinstance(value, dict):
        todo = [(root, value, (), "", False)]
    else:
        return
    while todo:
        path, value, ordinals, parent, repeated = todo.pop()
        if repeated:
            elements = [(None, x) for x in as_array(value) or ()]
        else:
            elements = [(None, value)]
        found = []
        for i, (_, x) in enumerate(elements):
            if not isinstance(x, dict):
                continue
            own, up = ((*ordinals, i), path) if repeated else (ordinals, parent)
            if repeated:
                emit(path, own, parent, ordinals, x, None)
            if path in prefixes:
                found.append((x, own, up))
        for x, own, up in reversed(found):
            member = paths.join(path, MEMBER) if path in paths.maps else ""
            if member in relations:
                for j, (k, v) in enumerate(x.items()):
                    if isinstance(v, dict):
                        emit(member, (*own, j), up, own, v, k)
                        if member in prefixes:
                            todo.append((member, v, (*own, j), member, False))
                continue
            for k, v in x.items():
                p = paths.join(path, k)
                if p in relations:
                    todo.append((p, v, own, up, True))
                elif p in prefixes and isinstance(v, dict):
                    todo.append((p, v, own, up, False))


def _inlined(element: dict, path: str, relations: set[str], paths: Paths, key: str | None) -> str:
    """The columns inlined into a row as JSON text with dotted names."""
    out: dict = {} if key is None else {KEY: key}
    todo = [(element, path, "")]
    while todo:
        value, at, local = todo.pop()
        for k, v in value.items():
            p, name = paths.join(at, k), f"{local}.{k}" if local else k
            if p in relations:
                continue
            if isinstance(v, dict) and p not in paths.maps:
                todo.append((v, p, name))
            elif v is not None:
                out[name] = _text(v) if isinstance(v, (list, dict)) else v
    return json.dumps(out, ensure_ascii=False)


def _text(value) -> str | None:
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pieces: list[str] = []
        todo: list = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                pieces.append(x[0])
            elif isinstance(x, dict) and x:
                todo.append(("}",))
                for n, (k, v) in enumerate(reversed(x.items())):
                    todo += [v, (json.dumps(k, ensure_ascii=False) + ": ",), *([(", ",)] if n < len(x) - 1 else [])]
                todo.append(("{",))
            elif isinstance(x, list) and x:
                todo.append(("]",))
                for n, v in enumerate(reversed(x)):
                    todo += [v, *([(", ",)] if n < len(x) - 1 else [])]
                todo.append(("[",))
            else:
                pieces.append(json.dumps(x, ensure_ascii=False))
        return "".join(pieces)


def shred(records: DataFrame, graph: SchemaGraph, record_id: str, column: str, root: str = "", with_columns: bool = True) -> DataFrame:
    """One row per object in each relation's arrays.

    Returns rec_id, arr_path, ordinals (zero-based positions from the outermost array in,
    joined by ``.``), parent_path and parent_ordinals (the foreign key; empty under the
    record itself), ``relation`` (where the row belongs: see :class:`SchemaGraph`) and, if
    wanted, ``row_json`` with the inlined columns. A single object counts as an array of one,
    JSON text of an array as that array; nulls and scalars in an array give no row but keep
    their position; the members of a map count by their position in it and have their name
    in the column ``@key``; invalid, null or empty records give nothing; a repeated record
    gives its rows again. A name with dots in it is written as it stands.
    """
    relations = set(graph.relations)
    prefixes = {r[:i] for r in relations for i, ch in enumerate(r) if ch == "."} | {""}
    prefixes |= {r for r in graph.relations if r.rpartition(".")[2] in r.split(".")[:-1]}  # below these it goes round
    relation_of, maps = dict(graph.relation_of), graph.maps
    size = 20_000

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        texts = ("arr_path", "ordinals", "parent_path", "parent_ordinals", "relation", *(["row_json"] if with_columns else []))
        schema = pa.schema([("rec_id", pa.int64()), *[(c, pa.string()) for c in texts]])
        rows: list[tuple] = []
        paths = Paths(maps)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            for rec, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value, ok = parse(text)
                if not ok:
                    continue

                def emit(path, ordinals, up, above, element, key, rec=rec):
                    row = (rec, path, ".".join(map(str, ordinals)), up, ".".join(map(str, above)) if up else "", relation_of[path])
                    rows.append((*row, _inlined(element, path, relations, paths, key)) if with_columns else row)

                shred_record(value, relations, prefixes, root, paths, emit)
                if len(rows) >= size:
                    yield flush()
                    rows.clear()
        if rows:
            yield flush()

    out = "rec_id bigint, arr_path string, ordinals string, parent_path string, parent_ordinals string, relation string" + (", row_json string" if with_columns else "")
    return records.select(F.col(record_id).cast("bigint"), F.col(column)).mapInArrow(run, out)


def relation_table(rows: DataFrame, graph: SchemaGraph, relation: str) -> DataFrame:
    """One relation of :func:`shred` as a flat table: keys, foreign key and its typed inlined columns.

    ``relation`` is a path, or the name of a shared or recursive element; its rows then come
    from all its places, told apart by arr_path, and refer to their parent by parent_path
    and parent_ordinals."""
    name = graph.relation_of.get(relation, relation)
    columns = graph.columns.get(name, {})
    keys = ["rec_id", "arr_path", "ordinals", "parent_path", "parent_ordinals"]
    keep = rows.where(F.col("relation") == name)
    if relation != name:  # one place of a shared element
        keep = keep.where(F.col("arr_path") == relation)
    keep = keep.select(*keys, "row_json")
    if not columns:
        return keep.drop("row_json")
    parsed = keep.withColumn("__row", F.from_json("row_json", "map<string,string>"))
    out, taken = [], set(keys)
    for c in sorted(columns):
        alias = c
        while alias.lower() in taken:  # names that clash with the keys or differ only in letter case
            alias += "_"
        taken.add(alias.lower())
        out.append(F.element_at("__row", c).try_cast(columns[c]).alias(alias))
    return parsed.select(*keys, *out)

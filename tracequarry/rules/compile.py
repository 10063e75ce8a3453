"""Expressions to Spark columns, with two-valued logic.

A test on a missing field or a failed cast is false, and its negation true. SQL's null is
"not selected" under AND, OR and WHERE, so tests stay bare there (and can be pushed into
the scan); only under NOT, or when the truth is itself a column, nulls become false.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.rules.ir import And, AtLeast, CastOk, Compare, Const, Exists, Matrix, Nested, Node, Not, Null, Number, Or, Ref, Text

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower case for ASCII letters only, as rules compare."""
    return F.translate(c, _LETTERS, _LETTERS.lower())


def _fold(text: str) -> str:
    return text.translate(str.maketrans(_LETTERS, _LETTERS.lower()))


def double_text(x: Column) -> Column:
    """A floating-point number as rules see it: six significant digits without trailing zeros, ``1e+08`` from a million on."""
    short = F.format_string("%.5e", x)
    power = F.substring_index(short, "e", -1).cast("int")
    fixed = None
    for k in range(-4, 6):
        digits = F.format_string(f"%.{5 - k}f", short.cast("double"))
        fixed = F.when(power == k, digits) if fixed is None else fixed.when(power == k, digits)
    plain = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, F.lit("0")).when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(
        F.coalesce(plain, F.regexp_replace(short, r"\.?0+e", "e"))
    )


def value_text(column: Column, kind: T.DataType) -> Column:
    """A value as the text that text tests look at."""
    if isinstance(kind, T.StringType):
        return column
    return double_text(column.cast("double")) if isinstance(kind, (T.DoubleType, T.FloatType)) else column.cast("string")


class TypedFields:
    """Fields of a table with a schema: dotted paths become struct accesses, so scans are pruned and filtered."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.found: dict[str, tuple[Column, T.DataType] | None] = {}

    def _find(self, path: str) -> tuple[Column, T.DataType] | None:
        if path not in self.found:
            self.found[path] = self._look_up(path)
        return self.found[path]

    def _look_up(self, path: str) -> tuple[Column, T.DataType] | None:
        names = {f.name: f for f in self.schema.fields}
        if path in names:  # a column whose own name has dots
            return F.col(f"`{path}`"), names[path].dataType
        head, *rest = path.split(".")
        if head not in names:
            return None
        column, kind = F.col(f"`{head}`"), names[head].dataType
        for k, part in enumerate(rest):
            if isinstance(kind, T.StructType) and part in kind.names:
                column, kind = column.getField(part), kind[part].dataType
            elif isinstance(kind, T.MapType):
                column, kind = F.element_at(column, part), kind.valueType
            elif isinstance(kind, T.StringType):  # JSON text inside a column
                return F.get_json_object(column, "$" + "".join(f"['{p}']" for p in rest[k:])), T.StringType()
            else:
                return None
        return column, kind

    def value(self, path: str) -> tuple[Column, T.DataType]:
        return self._find(path) or (F.lit(None).cast("string"), T.StringType())

    def is_object(self, path: str) -> Column:
        column, kind = self.value(path)
        if isinstance(kind, (T.StructType, T.MapType)):
            return column.isNotNull()
        return F.ltrim(column.cast("string")).startswith("{") if isinstance(kind, T.StringType) else F.lit(False)

    def pushable(self, path: str) -> T.DataType | None:
        """The type of a plain column, on which scans can filter; None for other fields."""
        found = self._find(path)
        if found is None or not isinstance(found[1], (T.StringType, T.NumericType)):
            return None
        names = {f.name: f.dataType for f in self.schema.fields}
        at = path if path in names else path.split(".")[0]
        return found[1] if path in names or isinstance(names[at], T.StructType) else None


class VariantFields:
    """Fields of documents held in one VARIANT column (see :func:`documents_from_json`)."""

    def __init__(self, column: str = "data", aliases: dict[str, str] | None = None):
        """``aliases``: where a field is looked for if it is not at its own path."""
        self.column, self.aliases = column, aliases or {}
        self.found: dict[str, Column] = {}

    def _path(self, path: str) -> str:
        return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))

    def value(self, path: str) -> tuple[Column, T.DataType]:
        if path in self.found:
            return self.found[path], T.VariantType()
        data = F.col(f"`{self.column}`")
        text = F.try_variant_get(data, self._path(path), "string")
        if path in self.aliases:
            text = F.coalesce(text, F.try_variant_get(data, self._path(self.aliases[path]), "string"))
        self.found[path] = F.struct(text.alias("s"), F.try_variant_get(data, self._path(path), "array<string>").alias("a"))
        return self.found[path], T.VariantType()

    def is_object(self, path: str) -> Column:
        return F.try_variant_get(F.col(f"`{self.column}`"), self._path(path), "map<string,variant>").isNotNull()

    def pushable(self, path: str) -> None:
        return None


class MappedFields:
    """Fields under the names of a mapping: ``from`` names are read at their ``to`` paths.

    A field with a cast is that value as text of the number it begins with; one with a
    container is the member ``to`` of the payload. Other names are looked up as they are."""

    def __init__(self, base: TypedFields | VariantFields, specs):
        self.base = base
        self.specs = {s.source: s for s in specs if s.container or s.cast or s.source != s.to}

    def value(self, path: str) -> tuple[Column, T.DataType]:
        from tracequarry.rules.mapper import cast_value, container_value

        spec = self.specs.get(path)
        if spec is None:
            return self.base.value(path)
        column, kind = self.base.value(spec.container.field if spec.container else spec.to)
        variant = isinstance(kind, T.VariantType)
        if spec.container:
            text = container_value(column.getField("s") if variant else column.cast("string"), spec.container, spec.to)
            return text, T.StringType()
        if spec.cast is None or not (variant or isinstance(kind, T.StringType)):
            return (column.cast("string"), T.StringType()) if spec.cast == "str" and not variant else (column, kind)
        if variant:
            return F.struct(cast_value(column.getField("s"), spec.cast).alias("s"), column.getField("a").alias("a")), kind
        return cast_value(column, spec.cast), kind

    def inside(self, path: str) -> str:
        """Where an object under a mapped name really is."""
        spec = self.specs.get(path)
        return spec.to if spec is not None and not spec.container else path

    def is_object(self, path: str) -> Column:
        return self.base.is_object(self.inside(path))

    def pushable(self, path: str) -> T.DataType | None:
        spec = self.specs.get(path)
        return self.base.pushable(path if spec is None else spec.to) if spec is None or not (spec.container or spec.cast) else None


def documents_from_json(df: DataFrame, column: str, out: str = "data") -> DataFrame:
    """``df`` with its JSON text parsed into a VARIANT column; invalid text gives null.

    Of a name that an object repeats the last value counts. As that is a setting of the
    session (``spark.sql.variant.allowDuplicateKeys``), it is switched on here."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df.withColumn(out, F.try_parse_json(F.col(column)))


def balanced(tests: list[Column], how: str) -> Column:
    """All tests under one operator (``and``, ``or``) as a tree of logarithmic depth."""
    if len(tests) == 1:
        return tests[0]
    half = len(tests) // 2
    a, b = balanced(tests[:half], how), balanced(tests[half:], how)
    return a & b if how == "and" else a | b


class Compiler:
    """Compiles expressions against one way of finding fields."""

    def __init__(self, fields: TypedFields | VariantFields):
        self.fields = fields

    def predicate(self, node: Node) -> Column:
        """For WHERE: null means not selected."""
        return self._node(node, "")

    def truth(self, node: Node) -> Column:
        """As a column: never null."""
        return F.coalesce(self._node(node, ""), F.lit(False))

    def _text_test(self, value: Column, test: Text) -> Column:
        if test.how == "regex":
            return value.rlike(("(?i)" if test.ignore_case else "") + test.value)
        wanted = _fold(test.value) if test.ignore_case else test.value
        value = ascii_lower(value) if test.ignore_case else value
        return {"exact": lambda: value == wanted, "contains": lambda: value.contains(wanted), "startswith": lambda: value.startswith(wanted), "endswith": lambda: value.endswith(wanted)}[test.how]()

    def _on_values(self, path: str, test) -> Column:
        column, kind = self.fields.value(path)
        if isinstance(kind, T.VariantType):
            return F.when(column.getField("a").isNotNull(), F.exists(column.getField("a"), test)).otherwise(test(column.getField("s")))
        if isinstance(kind, T.ArrayType):
            return F.exists(column, lambda x: test(value_text(x, kind.elementType)))
        if isinstance(kind, (T.StructType, T.MapType)):
            return F.lit(False)
        return test(value_text(column, kind))

    def _number(self, path: str, whole: bool) -> Column:
        column, kind = self.fields.value(path)
        if isinstance(kind, T.VariantType):
            column = F.when(column.getField("a").isNull(), column.getField("s"))
            kind = T.StringType()
        if isinstance(kind, T.NumericType):
            return column
        if not isinstance(kind, T.StringType):
            return F.lit(None).cast("double")
        if whole:
            return column.try_cast("bigint")
        return F.regexp_extract(column, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")

    def _present(self, path: str) -> Column:
        column, kind = self.fields.value(path)
        return column.getField("s").isNotNull() | column.getField("a").isNotNull() if isinstance(kind, T.VariantType) else column.isNotNull()

    def _node(self, node: Node, prefix: str) -> Column:
        at = lambda p: f"{prefix}.{p}" if prefix else p
        match node:
            case And(items):
                return balanced([self._node(x, prefix) for x in items], "and") if items else F.lit(True)
            case Or(items):
                lists, rest = _equalities(items)
                tests = [self._number(at(path), True).isin(*ws) if how == "number" else self._on_values(at(path), _one_of(ws, ig, how)) for (how, path, ig), ws in lists]
                tests += [self._node(x, prefix) for x in rest]
                return balanced(tests, "or") if tests else F.lit(False)
            case AtLeast(n, items):
                return reduce(lambda a, b: a + b, [F.coalesce(self._node(x, prefix), F.lit(False)).cast("int") for x in items], F.lit(0)) >= n
            case Not(item):
                return ~F.coalesce(self._node(item, prefix), F.lit(False))
            case Const(value):
                return F.lit(value)
            case Number():
                return F.lit(True)
            case Null():
                return F.lit(False)
            case Exists(path):
                return self._present(at(path))
            case CastOk(kind, path):
                return self._present(at(path)) if kind == "str" else self._number(at(path), False).isNotNull()
            case Compare(path, op, value, whole):
                x = self._number(at(path), whole)
                y = F.lit(int(value)) if float(value).is_integer() and abs(value) < 2**53 else F.lit(float(value))
                return {"==": x == y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
            case Text(path, _, _, _):
                return self._on_values(at(path), lambda v: self._text_test(v, node))
            case Nested(path, item):
                here = at(path)
                inner = self.fields.inside(here) if not prefix and isinstance(self.fields, MappedFields) else here
                return self.fields.is_object(here) & self._node(item, inner)
            case Matrix(paths, rows):
                fit = [r for r in rows if len(r) == len(paths)]
                return self._node(Or(tuple(And(tuple(Text(p, *t) if isinstance(t, tuple) else t for p, t in zip(paths, r))) for r in fit)), prefix)
            case Ref(name):
                raise ValueError(f"unresolved identifier: {name}")
        raise TypeError(f"not an expression: {node!r}")


#: Regular expressions around an alternation, by how its texts are looked for.
_ALTERNATIONS = {"contains": "(?s)(?:{})", "startswith": "(?s)^(?:{})", "endswith": r"(?s)(?:{})\z"}


def _one_of(values: list[str], ignore_case: bool, how: str):
    if how == "text":
        return lambda v: (ascii_lower(v) if ignore_case else v).isin(*values)
    pattern = _ALTERNATIONS[how].format("|".join(re.sub(r"([^\w\s])", r"\\\1", x, flags=re.ASCII) if x.isascii() else "".join(c if c.isalnum() or c == " " or not c.isascii() else "\\" + c for c in x) for x in values))
    return lambda v: (ascii_lower(v) if ignore_case else v).rlike(pattern)


def _equalities(items: tuple) -> tuple[list, list]:
    """Tests of one field against three or more values as lists of values, and the other items.

    Equalities become a list of values; texts to be contained, or to begin or end with, one
    alternation, which a single pass over the field's text tests."""
    groups: dict[tuple, list] = {}
    for x in items:
        if isinstance(x, Text) and x.how in _ALTERNATIONS:
            groups.setdefault((x.how, x.path, x.ignore_case), []).append(x)
        elif isinstance(x, Text) and x.how == "exact":
            groups.setdefault(("text", x.path, x.ignore_case), []).append(x)
        elif isinstance(x, Compare) and x.op == "==" and x.whole and abs(x.value) < 2**53:
            groups.setdefault(("number", x.path, False), []).append(x)
    groups = {k: v for k, v in groups.items() if len(v) >= 3}
    taken = {id(x) for v in groups.values() for x in v}
    lists = [(k, [int(x.value) if k[0] == "number" else _fold(x.value) if k[2] else x.value for x in v]) for k, v in groups.items()]
    return lists, [x for x in items if id(x) not in taken]


def portable_regex(pattern: str) -> str:
    """The pattern, if it keeps to what all engines read alike; else an error."""
    if re.search(r"\(\?<[=!]|\(\?>|[+*?]\+|\\[AZzGQE]", pattern):
        raise ValueError(f"pattern uses constructs that are not portable: {pattern}")
    re.compile(pattern)
    return pattern

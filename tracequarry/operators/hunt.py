"""Hunting: many rules over documents in one scan, and the rules' counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.search import in_range, parse_timestamp
from tracequarry.rules.compile import Compiler, MappedFields, TypedFields, VariantFields, balanced
from tracequarry.rules.ir import Or
from tracequarry.rules.mapper import Mapping, bind
from tracequarry.rules.optimize import necessary, optimize, weaker
from tracequarry.rules.parse import Aggregate, Rule
from tracequarry.runtime import many_columns
from tracequarry.sources.evtx import ALIASES

#: Tests per array expression; all arrays of all rules are computed in the same projection over one scan.
TESTS_PER_ARRAY = 100
#: Most rules whose whole scan conditions are put before the tests; of more rules one equality each is.
FULL_FILTERS = 16


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """Metadata of the rules; as many rows as rules."""
    rows = [(r.name, r.group, r.level, r.status, r.kind, list(r.authors), r.description) for r in rules]
    return spark.createDataFrame(rows, "rule string, rule_group string, level string, status string, kind string, authors array<string>, description string")


def sql_text(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _time(column: Column, type_name: str) -> Column:
    return (column if type_name.startswith("timestamp") else parse_timestamp(column.cast("string"))).cast("timestamp")


def _choose(index: Column, values: Sequence[Callable[[], Column]], kinds: Sequence) -> Column:
    """The value of the rule with the given index; rules of the same ``kinds`` share one branch."""
    rows: dict = {}
    for i, k in enumerate(kinds):
        rows.setdefault(k, []).append(i)
    if len(rows) == 1:
        return values[0]()
    out = None
    for at in rows.values():
        test = index.isin(*at)
        out = F.when(test, values[at[0]]()) if out is None else out.when(test, values[at[0]]())
    return out


def hunt(
    df: DataFrame,
    rules: Sequence[Rule],
    mappings: Sequence[Mapping] = (),
    kind: Column | str | None = None,
    timestamp: str | None = None,
    start: str | None = None,
    end: str | None = None,
    levels: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    variant: str | None = None,
    own_time: bool = False,
    with_keys: bool = False,
) -> DataFrame:
    """One row per (document, rule) that matches: the document's columns, then hunt, rule, level, status.

    All rules are tested in one projection over one scan, however many there are: the
    indexes of the matching ones are collected in an array and exploded, so no join takes
    place. What every match needs (equalities and ranges on plain columns) is put before it
    as a filter that reaches the scan.

    A rule reads fields through its mapping: those of the mapping's group for other engines'
    rules, its own for native ones; each ``from`` name is looked up at its ``to`` path, with
    its cast or out of its container. Two fields of event logs are also found where they are
    attributes (``ALIASES``). ``kind`` is the documents' kind (a column, or a
    constant text); without it every rule is tested on every document.

    ``timestamp`` names one column for the time range. With ``own_time`` the time is that of
    the rule or mapping group instead, given as column ``hit_ts``, and a document without a
    readable time is no hit. A missing time is outside any given range. ``with_keys`` adds
    ``agg_key``: the texts of the rule's aggregate fields, null for rules without.
    """
    with many_columns():
        return _hunt(df, rules, mappings, kind, timestamp, start, end, levels, statuses, kinds, variant, own_time, with_keys)


def _hunt(df, rules, mappings, kind, timestamp, start, end, levels, statuses, kinds, variant, own_time, with_keys) -> DataFrame:
    wanted = [r for r in rules if (not levels or r.level in levels) and (not statuses or r.status in statuses) and (not kinds or r.kind in kinds)]
    bound = bind(wanted, list(mappings))
    types = dict(df.dtypes)
    if timestamp is not None and not own_time and (start is not None or end is not None):
        df = df.where(in_range(_time(F.col(timestamp), types[timestamp]), start, end))
    if isinstance(kind, str):
        bound = [b for b in bound if b[3] == ("json" if kind == "jsonl" else kind)]
    names = list(df.columns)
    added = (["hit_ts"] if own_time else []) + (["agg_key"] if with_keys else [])
    if not bound:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("hunt", "rule", "level", "status")]
        nothing += [F.lit(None).cast({"hit_ts": "timestamp", "agg_key": "array<string>"}[c]).alias(c) for c in added]
        return df.where(F.lit(False)).select("*", *nothing)
    plain = VariantFields(variant, ALIASES if any(b[3] == "evtx" for b in bound) else None) if variant else TypedFields(df.schema)
    seen: dict = {}
    found = []
    for r, g, _, _ in bound:  # one resolver per distinct mapping
        specs = g.fields if g else r.fields
        found.append(seen.setdefault(specs, MappedFields(plain, specs) if specs else plain))
    times = [((g.timestamp if g else r.timestamp), f) for (r, g, _, _), f in zip(bound, found)]

    def time_of(i: int) -> Column:
        column, of = times[i][1].value(times[i][0])
        text = column.getField("s") if of.typeName() == "variant" else column
        return _time(text, "string" if of.typeName() == "variant" else of.typeName())

    tests, needs = [], []
    for j, (_, _, expression, of_kind) in enumerate(bound):
        compiler = Compiler(found[j])
        shaped = optimize(expression)
        test = compiler.predicate(shaped)
        if isinstance(kind, Column):
            test = (F.when(kind == "jsonl", "json").otherwise(kind) == of_kind) & test
        if own_time:
            test = test & time_of(j).isNotNull() & in_range(time_of(j), start, end)
        tests.append(F.when(test, F.lit(j)))
        needs.append((found[j], necessary(shaped, found[j].pushable)))
    if all(n is not None for _, n in needs):
        unique: dict = {}
        for f, n in needs:  # many rules: one test of each, so that equalities merge into lists
            unique.setdefault(f, []).append(weaker(n) if len(needs) > FULL_FILTERS else n)
        df = df.where(balanced([Compiler(f).predicate(optimize(Or(tuple(dict.fromkeys(ns))))) for f, ns in unique.items()], "or"))
    arrays = [F.array_compact(F.array(*tests[i : i + TESTS_PER_ARRAY])) for i in range(0, len(tests), TESTS_PER_ARRAY)]
    hit = df.withColumn("__rule", F.explode(F.concat(*arrays)))
    rows = (f"struct({sql_text(g.name if g else r.group)} AS hunt, {sql_text(r.name)} AS rule, {sql_text(r.level)} AS level, {sql_text(r.status)} AS status)" for r, g, _, _ in bound)
    info = F.expr(f"array({', '.join(rows)})")  # one call for all rules; Catalyst folds it to a constant
    index = F.col("__rule")
    extra = []
    if own_time:
        extra.append(_choose(index, [lambda i=i: time_of(i) for i in range(len(bound))], times).alias("hit_ts"))
    if with_keys:

        def key_of(i: int) -> Column:
            aggregate = bound[i][0].aggregate
            return F.array(*[_text(found[i], f) for f in aggregate.fields]).cast("array<string>") if aggregate else F.lit(None).cast("array<string>")

        kinds_of = [(found[i], b[0].aggregate.fields) if b[0].aggregate else None for i, b in enumerate(bound)]
        extra.append(_choose(index, [lambda i=i: key_of(i) for i in range(len(bound))], kinds_of).alias("agg_key"))
    out = hit.withColumn("__info", F.element_at(info, index + 1))
    return out.select(*[F.col(f"`{c}`") for c in names], "__info.hunt", "__info.rule", "__info.level", "__info.status", *extra)


def _text(fields, path: str) -> Column:
    column, of = fields.value(path)
    return column.getField("s") if of.typeName() == "variant" else column.cast("string")


def compare(n: Column, aggregate: Aggregate) -> Column:
    return {"==": n == aggregate.n, ">": n > aggregate.n, ">=": n >= aggregate.n, "<": n < aggregate.n, "<=": n <= aggregate.n}[aggregate.op]


def _keyed(hits: DataFrame, rules: Sequence[Rule], strings_only: bool) -> DataFrame:
    """Hits of rules with an aggregate, with ``key``; those with a null among its values are left out."""
    if "agg_key" in hits.columns:
        key = F.col("agg_key")
    else:
        schema = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
        found = TypedFields(hits.schema)
        by_fields: dict[tuple, list[str]] = {}
        for r in rules:
            if r.aggregate:
                by_fields.setdefault(r.aggregate.fields, []).append(r.name)
        key = F.lit(None).cast("array<string>")
        for n, (fields, names) in enumerate(by_fields.items()):
            values = [found.value(f)[0].cast("string") if not strings_only or schema.get(f, "string") == "string" else F.lit(None).cast("string") for f in fields]
            value = F.array(*values) if values else F.array().cast("array<string>")
            key = F.when(F.col("rule").isin(*names), value) if n == 0 else key.when(F.col("rule").isin(*names), value)
    return hits.withColumn("key", key).where(F.col("key").isNotNull() & ~F.exists("key", lambda x: x.isNull()))


def _meets(rules: Sequence[Rule]) -> Column:
    """Whether ``n_docs`` meets the count of ``rule``: one comparison per operator, the numbers in a literal map."""
    by_op: dict[str, list] = {}
    for r in rules:
        if r.aggregate:
            by_op.setdefault(r.aggregate.op, []).extend((F.lit(r.name), F.lit(r.aggregate.n)))
    n = F.col("n_docs")
    tests = []
    for op, pairs in by_op.items():
        wanted = F.element_at(F.create_map(*pairs), F.col("rule"))
        tests.append({"==": n == wanted, ">": n > wanted, ">=": n >= wanted, "<": n < wanted, "<=": n <= wanted}[op])
    return F.coalesce(F.lit(False) if not tests else balanced([F.coalesce(t, F.lit(False)) for t in tests], "or"), F.lit(False))


def aggregate_hits(
    hits: DataFrame, rules: Sequence[Rule], timestamp: str, source: str | None = None, document: str | None = None, strings_only: bool = False
) -> DataFrame:
    """Groups of hits that meet their rule's count: [source,] rule, key, n_docs and first_seen.

    Hits are grouped by source, rule and the rule's aggregate fields, as texts (``agg_key``
    of :func:`hunt` where present); a hit with a null (or, with ``strings_only``, non-text)
    field is not grouped. ``document`` names what is counted once per group for aggregates
    marked distinct; others count hits. Counts and the earliest time are algebraic, so a hot
    group costs one partial row per task.
    """
    keyed = _keyed(hits, rules, strings_only)
    by = ([source] if source else []) + ["rule", "key"]
    distinct = [r for r in rules if r.aggregate and r.aggregate.distinct]
    counted = keyed.groupBy(*by).agg(F.count("*").alias("n_docs"), F.min(timestamp).alias("first_seen"))
    if distinct and document:
        once = keyed.where(F.col("rule").isin(*[r.name for r in distinct])).groupBy(*by, document).agg(F.min(timestamp).alias("__t"))
        own = once.groupBy(*by).agg(F.count(document).alias("n_docs"), F.min("__t").alias("first_seen"))
        counted = counted.where(~F.col("rule").isin(*[r.name for r in distinct])).unionByName(own)
    return counted.where(_meets(rules))


def aggregate_documents(
    hits: DataFrame, rules: Sequence[Rule], timestamp: str, source: str | None = None, document: str | None = None, strings_only: bool = False
) -> DataFrame:
    """The documents of the groups that :func:`aggregate_hits` gives: one row per hit, with key, n_docs and first_seen.

    A group's documents stay rows: a list of all of them would have to fit into one task."""
    keyed = _keyed(hits, rules, strings_only)
    groups = aggregate_hits(hits, rules, timestamp, source, document, strings_only)
    return keyed.drop("agg_key").join(groups, ([source] if source else []) + ["rule", "key"])


def run_summary(hits: DataFrame, source: str) -> DataFrame:
    """Hits, sources with hits, and rules that hit."""
    return hits.agg(F.count("*").alias("n_hits"), F.count_distinct(source).alias("n_sources"), F.count_distinct("rule").alias("n_rules"))

"""The column compiler against a plain evaluator, and the parsers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracequarry.operators.hunt import aggregate_hits, hunt
from tracequarry.operators.search import in_range, parse_timestamp, search
from tracequarry.rules import sigma
from tracequarry.rules.compile import Compiler, TypedFields, VariantFields, documents_from_json
from tracequarry.rules.ir import And, AtLeast, CastOk, Compare, Const, Exists, Nested, Not, Or, Ref, Text, fields, rename
from tracequarry.rules.mapper import map_fields, parse_mapping
from tracequarry.rules.optimize import CyclicReference, optimize
from tracequarry.rules.parse import RuleError, lint, load_rules, parse_condition, parse_field, parse_filter, parse_kv, parse_rule


def find(doc, path):
    for part in path.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return None
        doc = doc[part]
    return doc


def shown(v):
    return str(v).lower() if isinstance(v, bool) else str(v)


def fold(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def solve(node, doc):
    match node:
        case And(items):
            return all(solve(x, doc) for x in items)
        case Or(items):
            return any(solve(x, doc) for x in items)
        case AtLeast(n, items):
            return sum(solve(x, doc) for x in items) >= n
        case Not(item):
            return not solve(item, doc)
        case Const(value):
            return value
        case Exists(path):
            return find(doc, path) is not None
        case CastOk(_, path):
            return number(find(doc, path)) is not None
        case Compare(path, op, value, _):
            x = number(find(doc, path))
            return x is not None and {"==": x == value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[op]
        case Text(path, how, value, ignore):
            v = find(doc, path)
            if v is None or isinstance(v, dict):
                return False
            return any(text(how, shown(x), value, ignore) for x in (v if isinstance(v, list) else [v]))
        case Nested(path, item):
            v = find(doc, path)
            return isinstance(v, dict) and solve(item, v)
    raise TypeError(node)


def number(v):
    if isinstance(v, bool) or isinstance(v, (list, dict)) or v is None:
        return None
    m = re.match(r"\s*([+-]?\d+(\.\d+)?)", str(v))
    return float(m[1]) if m else None


def text(how, v, value, ignore):
    if how == "regex":
        return re.search(value, v, re.I if ignore else 0) is not None
    if ignore:
        v, value = fold(v), fold(value)
    return {"exact": v == value, "contains": value in v, "startswith": v.startswith(value), "endswith": v.endswith(value)}[how]


PATHS = ["a", "b", "c.d", "c.e", "f", "nope", "c.nope"]


def some_node(depth=0):
    k = random.random()
    if depth < 3 and k < 0.45:
        items = tuple(some_node(depth + 1) for _ in range(random.randint(0, 3)))
        return random.choice([And(items), Or(items), Not(some_node(depth + 1)), AtLeast(random.randint(0, 3), items)])
    p = random.choice(PATHS)
    return random.choice(
        [Exists(p), Compare(p, random.choice(["==", ">", ">=", "<", "<="]), random.randint(0, 4)), Const(random.random() < 0.5), Nested("c", Text("d", "exact", "x1")), CastOk("flt", p)]
        + [Text(p, how, random.choice(["x", "X1", "1", "é", "2"]), random.random() < 0.5) for how in ("exact", "contains", "startswith", "endswith", "regex")]
    )


def some_doc():
    v = lambda: random.choice([None, "x1", "X", "1", "2.5", 3, 2, "É", "xé", ""])
    doc = {"a": v(), "b": random.randint(0, 4), "c": {"d": v(), "e": v()}, "f": random.choice([["x1", "2"], [], ["é"]])}
    return {k: x for k, x in doc.items() if random.random() < 0.85}


@pytest.mark.parametrize("form", ["json", "typed"])
def test_random_expressions(spark, form):
    random.seed(11)
    docs, nodes = [some_doc() for _ in range(60)], [some_node() for _ in range(60)]
    if form == "json":
        df = documents_from_json(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string"), "j")
        compiler = Compiler(VariantFields("data"))
    else:
        docs = [{**d, "a": None if d.get("a") is None else str(d["a"]), "c": {k: None if v is None else str(v) for k, v in (d.get("c") or {}).items()}} for d in docs]
        df = spark.createDataFrame([(i, d.get("a"), d.get("b"), d["c"], d.get("f")) for i, d in enumerate(docs)], "i int, a string, b int, c struct<d:string,e:string>, f array<string>")
        compiler = Compiler(TypedFields(df.schema))
    got = {r[0]: list(r)[1:] for r in df.select("i", *[compiler.truth(n) for n in nodes]).collect()}
    simple = {r[0]: list(r)[1:] for r in df.select("i", *[compiler.truth(optimize(n)) for n in nodes]).collect()}
    for i, d in enumerate(docs):
        want = [solve(n, d) for n in nodes]
        assert got[i] == want and simple[i] == want


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "cast(id AS string) AS b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(Compiler(TypedFields(df.schema)).predicate(And((Compare("a", ">", 5), Text("b", "exact", "7"))))).select("a")._jdf.queryExecution().toString()
    assert "GreaterThan(a,5)" in plan and "EqualTo(b,7)" in plan


def test_terms_and_conditions():
    assert parse_kv("a: >=5") == Compare("a", ">=", 5.0, True) and parse_kv("a: =4104") == Compare("a", "==", 4104.0, True)
    assert parse_kv("a: i*x*") == Text("a", "contains", "x", True) and parse_kv("a: !x") == Not(Text("a", "exact", "x")) and parse_kv("str(a): 5") == Text("a", "exact", "5")
    assert parse_kv("not(a): 5") == Not(Compare("a", "==", 5.0, True)) and parse_kv("a: ?x+") == Text("a", "regex", "x+")
    assert parse_condition("a or b and not c", {"a", "b", "c"}) == Or((Ref("a"), And((Ref("b"), Not(Ref("c"))))))
    assert parse_condition("", set()) == Const(True) and isinstance(parse_condition("of(x, 2)", {"x_0", "x_1", "x_2"}), AtLeast)
    for bad in ("a b", "(a", "and", "a or"):
        with pytest.raises(RuleError):
            parse_condition(bad, {"a", "b"})
    with pytest.raises(CyclicReference):
        optimize(Ref("a"), {"a": Ref("b"), "b": Ref("a")})
    with pytest.raises(RuleError):
        parse_kv("nothing")
    node = parse_filter({"condition": "a and not b", "a": {"x.y": ["p", "q", "r"]}, "b": {"z": 1}})
    assert fields(node) == {"x.y", "z"} and fields(rename(node, {"z": "w"})) == {"x.y", "w"}


def test_sigma_conversion():
    body, _ = sigma.to_filter({"search": {"CommandLine|contains": " -Nop "}, "condition": "search"})
    assert body == {"condition": "search", "search": {"CommandLine": "i* -Nop *"}}
    text = "action: global\ntitle: T\ndetection: {base: {EventID: 4688}, condition: search and base}\n---\ndetection: {search: {A|endswith: x}}\n---\ndetection: {search: {A|startswith: y}}\n"
    rules = sigma.load(text)
    assert len(rules) == 2 and rules[0].meta["filter"]["condition"] == "search and base" and rules[0].level == "info"
    assert sigma.to_filter({"a1": {"x": 1}, "a2": {"y": 2}, "condition": "1 of a* and NOT a1"})[0]["condition"] == "(a1 or a2) and not a1"
    assert sigma.base64_offsets("foo") == ["Zm9v", "Zvb", "mb2"]
    for bad in ({"a": {"x|wide": 1}, "condition": "a"}, {"a": ["k"], "condition": "a"}, {"a": {"x": 1}, "condition": "a | near b"}, {"a": {"x": 1}, "condition": "2 of a"}, {"a": {"x": 1}}):
        with pytest.raises(RuleError):
            sigma.to_filter(bad)
    assert sigma.to_filter({"a": {"x": 1}, "timeframe": "5m", "condition": "a | count() by h > 3"})[1].fields == ("h",)


def test_rule_files(tmp_path):
    (tmp_path / "a.yml").write_text("title: A\ngroup: G\nkind: json\nlevel: low\nstatus: stable\nfilter: {condition: s, s: {x: 1}}\n")
    (tmp_path / "b.yaml").write_text("name: B\ngroup: G\nkind: json\nlevel: none\nstatus: stable\nfilter: 'x: 1'\n")
    (tmp_path / "c.txt").write_text("")
    got = {f.rpartition("/")[2]: e for f, e, _ in lint(tmp_path)}
    assert got["a.yml"] is None and "unknown level" in got["b.yaml"] and len(got) == 2
    assert [r.name for r in load_rules(tmp_path / "a.yml", levels=["low"])] == ["A"] and load_rules(tmp_path / "a.yml", kinds=["mft"]) == []
    with pytest.raises(RuleError):
        load_rules(tmp_path / "c.txt")


def test_mapping_fields(spark):
    df = spark.createDataFrame([("12abc", '{"k": "v"}', "a=1; b=2;b=3", 1.5)], "n string, j string, kv string, d double")
    specs = [parse_field(f) for f in (
        {"name": "N", "from": "n", "to": "int(n)"}, {"name": "K", "from": "j", "to": "k", "container": {"field": "j", "format": "json"}},
        {"name": "B", "to": "b", "container": {"field": "kv", "format": "kv", "delimiter": ";", "separator": "=", "trim": True}}, {"name": "D", "from": "d", "to": "str(d)"},
        {"name": "missing"}, {"name": "hidden", "visible": False},
    )]
    assert map_fields(df, specs).first().asDict() == {"N": "12", "K": "v", "B": "2", "D": "1.500000", "missing": None}
    with pytest.raises(RuleError):
        parse_field({"name": "x", "to": "int(x)", "container": {"field": "y", "format": "json"}})
    with pytest.raises(RuleError):
        parse_mapping({"kind": "evtx"})


def test_hunt_edges(spark):
    spec = {"group": "G", "kind": "evtx", "level": "low", "status": "stable"}
    rules = [parse_rule({**spec, "name": n, "filter": {"id": i}, "aggregate": {"count": ">1", "fields": ["host"], "distinct": n == "d"}}) for n, i in (("d", 1), ("e", 1), ("f", 2))]
    df = spark.createDataFrame([(1, "h", "evtx", 10, 1), (1, "h", "evtx", 10, 2), (1, None, "evtx", 11, 3), (2, "h", "json", 12, 4), (None, "h", None, None, 5)], "id int, host string, kind string, doc int, t int")
    hits = hunt(df, rules, kind=F.col("kind"))
    assert sorted((r.rule, r.t) for r in hits.collect()) == [(n, t) for n in "de" for t in (1, 2, 3)]
    groups = aggregate_hits(hits, rules, "t", document="doc")
    assert [(r.rule, r.key, r.n_docs, r.first_seen) for r in groups.collect()] == [("e", ["h"], 2, 1)]
    assert hunt(df, []).collect() == [] and hunt(df.limit(0), rules).collect() == []


def test_search_and_times(spark):
    df = spark.createDataFrame([(1, "Alpha", "2024-01-01T00:00:00.1234567Z"), (2, "beta", "2024-01-02 00:00:00"), (3, None, "bad"), (4, "alpha", None)], "id int, s string, t string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(search(df, ["alpha"])) == [4] and ids(search(df, ["alpha"], ignore_case=True)) == [1, 4] and ids(search(df)) == [1, 2, 3, 4]
    assert ids(search(df, ["beta"], ["s: i*alph*"], match_any=False)) == [] and ids(search(df, [], ["s: beta", "id: 4"], match_any=True)) == [2, 4]
    assert ids(search(df, timestamp="t", start="2024-01-01", end="2024-01-02")) == [1]
    assert str(df.select(parse_timestamp(F.col("t"))).first()[0]) == "2024-01-01 00:00:00.123456"
    assert df.where(in_range(F.lit("2024-01-01").cast("timestamp"), "2024-01-01", None)).count() == 0


def test_all_events_are_mapped(spark, data):
    from tracequarry.plans import catalogue
    from tracequarry.runtime import table

    got = catalogue.queries()["mapper_container_json"](spark, data)
    assert got.columns == ["event_id", "k", "kind", "usr"] and got.count() == table(spark, data, "events").count()


def test_lists_of_texts_are_one_pass(spark):
    from tracequarry.rules.compile import Compiler, TypedFields
    from tracequarry.rules.ir import Or, Text

    rows = ["a.b", "axb", "C:\\Temp\\x.exe", "x.EXE", "ünï(1)", "line\nend", "", None, "q^$", "say $5|6"]
    df = spark.createDataFrame([(v,) for v in rows], "f string")
    c = Compiler(TypedFields(df.schema))
    for how, values in (("contains", ["a.b", "(1)", "$5|6", "\\temp"]), ("startswith", ["c:", "ü", "q^"]), ("endswith", [".exe", "end", "^$"])):
        for ignore in (False, True):
            node = Or(tuple(Text("f", how, v, ignore) for v in values))
            fold = (lambda x: "".join(ch.lower() if ch.isascii() else ch for ch in x)) if ignore else (lambda x: x)
            test = {"contains": lambda a, b: b in a, "startswith": str.startswith, "endswith": str.endswith}[how]
            want = [v is not None and any(test(fold(v), fold(x)) for x in values) for v in rows]
            assert [r[0] for r in df.select(c.truth(node)).collect()] == want, (how, ignore)
            assert "RLike" in df.where(c.predicate(node))._jdf.queryExecution().optimizedPlan().toString() or "rlike" in df.where(c.predicate(node))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_literals_and_pattern_files(tmp_path):
    from tracequarry.rules.ir import Const
    from tracequarry.rules.parse import load_patterns, parse_filter

    assert parse_filter({"condition": "a or null", "a": {"x": "1"}}) == parse_filter({"condition": "a or null", "a": {"x": "1"}})
    assert parse_filter({"condition": "true", "a": {"x": "1"}}) == Const(True)
    (tmp_path / "p").write_text("# no\n\n  \na+b\r\nc\n")
    assert load_patterns(tmp_path / "p") == ["a+b", "c"]


def test_hunt_reads_one_scan_with_filters(spark, data):
    from tracequarry.plans import engine_queries as q

    for name in ("hunt_500_rules", "hunt_multi_rule"):
        plan = q.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "PushedFilters: []" not in plan


def test_field_forms_and_casts(spark):
    from tracequarry.rules.ir import And, Nested, Text, fields, rename
    from tracequarry.rules.mapper import map_fields
    from tracequarry.rules.parse import RuleError, parse_field

    short = parse_field({"name": "a"})
    assert (short.source, short.to, short.name, short.cast, short.visible) == ("a", "a", "a", None, True)
    specs = [parse_field({"name": "I", "from": "t", "to": "int(t)"}), parse_field({"name": "F", "from": "t", "to": "flt(t)"}), parse_field({"name": "S", "from": "d", "to": "str(d)"}), parse_field({"name": "no", "from": "t", "visible": False})]
    df = spark.createDataFrame([("12abc", 1.5), (" -3.25e1x", 2.0), ("none", None)], "t string, d double")
    assert [tuple(r) for r in map_fields(df, specs).collect()] == [("12", "12.0", "1.500000"), ("-3", "-32.5", "2.000000"), ("none", "none", None)]
    with pytest.raises(RuleError):
        parse_field({"name": "x", "to": "int(x)", "container": {"field": "f", "format": "json"}})
    with pytest.raises(RuleError):
        parse_field({})
    node = And((Text("a", "exact", "1"), Nested("b", Text("c", "exact", "2"))))
    assert fields(node) == {"a", "b", "b.c"}
    assert rename(node, {"a": "x.y", "b": "z"}) == And((Text("x.y", "exact", "1"), Nested("z", Text("c", "exact", "2"))))


def test_mapped_hunts(spark):
    from tracequarry.operators.hunt import aggregate_hits, hunt
    from tracequarry.rules.compile import documents_from_json
    from tracequarry.rules.parse import parse_rule

    docs = [
        (1, '{"Event": {"System": {"TimeCreated_attributes": {"SystemTime": "2024-01-01T00:00:00Z"}, "Provider_attributes": {"Name": "P"}, "EventID": 7}, "EventData": {"Payload": "a=1; b=2", "J": "{\\"k\\": \\"v\\"}", "N": "15x"}}}'),
        (2, '{"Event": {"System": {"TimeCreated": "2024-01-02T00:00:00Z", "Provider": "P", "EventID": 7}, "EventData": {"Payload": "b=3", "N": "9"}}}'),
        (3, '{"Event": {"System": {"TimeCreated": "no time", "Provider": "P"}}}'), (4, None), (5, '{"a": 1, "a": 2}'),
    ]
    df = documents_from_json(spark.createDataFrame(docs, "i int, t string"), "t")
    base = {"group": "g", "kind": "evtx", "level": "low", "status": "stable", "timestamp": "Event.System.TimeCreated"}
    fields = [
        {"name": "b", "from": "B", "to": "b", "container": {"field": "Event.EventData.Payload", "format": "kv", "delimiter": ";", "separator": "=", "trim": True}},
        {"name": "k", "from": "K", "to": "k", "container": {"field": "Event.EventData.J", "format": "json"}}, {"name": "n", "from": "Num", "to": "int(Event.EventData.N)"},
        {"name": "d", "from": "Data", "to": "Event.EventData"}, {"name": "q", "from": "plain"},
    ]
    tests = {"kv": {"B": "2"}, "json": {"K": "v"}, "cast": {"Num": ">10"}, "in": {"Data": {"N": "9"}}, "alias": {"Event.System.Provider": "P"}, "none": {"B": "9"}}
    rules = [parse_rule({**base, "name": n, "fields": fields, "filter": {"condition": "x", "x": t}}) for n, t in tests.items()]
    got = sorted((r.rule, r.i) for r in hunt(df, rules, variant="data").collect())
    assert got == [("alias", 1), ("alias", 2), ("alias", 3), ("cast", 1), ("in", 2), ("json", 1), ("kv", 1)]
    timed = hunt(df, rules, variant="data", own_time=True, start="2024-01-01T12:00:00")
    assert sorted((r.rule, r.i, str(r.hit_ts)) for r in timed.collect()) == [("alias", 2, "2024-01-02 00:00:00"), ("in", 2, "2024-01-02 00:00:00")]
    counted = [parse_rule({**base, "name": "c", "fields": fields, "filter": {"condition": "x", "x": {"Event.System.Provider": "P"}}, "aggregate": {"count": ">=1", "fields": ["B"]}})]
    hits = hunt(df, counted, variant="data", own_time=True, with_keys=True)
    assert sorted((r.key, r.n_docs) for r in aggregate_hits(hits, counted, "hit_ts").collect()) == [(["2"], 1), (["3"], 1)]
    assert df.where("i = 5").selectExpr("variant_get(data, '$.a', 'int') AS a").first().a == 2
    none = hunt(df, [], variant="data", own_time=True, with_keys=True)
    assert none.columns[-2:] == ["hit_ts", "agg_key"] and none.collect() == []

import json
import random

from tracequarry.operators import nested
from tracequarry.operators.skew import count_distinct_per_key, meets, rule_groups


def test_rule_groups_against_brute_force(spark):
    random.seed(4)
    rules = [(1, ">= 3", ["computer"]), (2, "=1", ["computer", "ip_address"]), (3, None, ["computer"]), (4, "<2", ["target_user"]), (5, "odd", ["computer"]), (6, ">1", ["nothing"]), (1, ">= 3", ["computer"])]
    pick = lambda *v: random.choice(v)
    hits = [(pick("hot", "hot", "hot", "b", None), random.randint(1, 7), pick(1, 2, 3, 4, None), pick("c1", "c2", None), pick("u", None), pick("i1", "i2", None), "x") for _ in range(800)]
    df = spark.createDataFrame(hits, "source_file string, rule_id int, doc_no bigint, computer string, target_user string, ip_address string, agg_count string")
    got = {tuple(r) for r in rule_groups(df, spark.createDataFrame(rules, "rule_id int, agg_count string, agg_fields array<string>")).collect()}
    want: dict = {}
    spec = {1: ["computer"], 2: ["computer", "ip_address"], 4: ["target_user"]}
    at = {"computer": 3, "target_user": 4, "ip_address": 5}
    for h in hits:
        if h[1] in spec and h[2] is not None:
            key = [h[at[f]] for f in spec[h[1]]]
            if None not in key:
                want.setdefault((h[0], h[1], "|".join(key)), set()).add(h[2])
    test = {1: lambda n: n >= 3, 2: lambda n: n == 1, 4: lambda n: n < 2}
    assert got == {(*k, len(v)) for k, v in want.items() if test[k[1]](len(v))}


def test_counts_of_empty_tables_and_patterns(spark):
    empty = spark.createDataFrame([], "k string, v bigint")
    assert count_distinct_per_key(empty, ["k"], "v").collect() == []
    df = spark.createDataFrame([(">= 5", 5), ("> 5", 5), ("7", 7), ("x", 1), (None, 1)], "p string, n bigint")
    assert [r[0] for r in df.select(meets(df.p, df.n)).collect()] == [True, False, True, None, None]


RECORDS = [
    (1, json.dumps({"a": {"list": [{"x": 1, "sub": [{"y": 1}, None, {"y": 2}]}, None, {"sub": {"y": 3}}], "plain": {"deep": 5}}})),
    (2, json.dumps({"a": {"list": {"x": 2, "sub": json.dumps([{"y": 4}])}}})),
    (3, '{"a": {"list": [{"x": 1'), (4, None), (5, ""), (6, "[1, 2]"), (7, '{"a": {"list": [NaN]}}'), (8, json.dumps({"a": None})), (8, json.dumps({"a": {"list": [3, "t", [], {}]}})),
    (9, '{"a":' * 3000 + "1" + "}" * 3000),
]


def test_shredding(spark):
    df = spark.createDataFrame(RECORDS, "row_id bigint, doc string")
    graph = nested.analyse(df, "doc")
    assert graph.relations == ["a.list", "a.list.sub"] and graph.parent["a.list.sub"] == "a.list"
    assert graph.columns[""] == {"a.plain.deep": "bigint", "a.a": "bigint"} and graph.columns["a.list"] == {"x": "bigint"}
    rows = nested.shred(df, graph, "row_id", "doc")
    got = {(r.rec_id, r.arr_path, r.ordinals, r.parent_ordinals) for r in rows.collect()}
    assert got == {
        (1, "a.list", "0", ""), (1, "a.list", "2", ""), (1, "a.list.sub", "0.0", "0"), (1, "a.list.sub", "0.2", "0"), (1, "a.list.sub", "2.0", "2"),
        (2, "a.list", "0", ""), (2, "a.list.sub", "0.0", "0"), (8, "a.list", "3", ""),
    }
    table = nested.relation_table(rows, graph, "a.list.sub")
    assert sorted((r.rec_id, r.ordinals, r.y) for r in table.collect()) == [(1, "0.0", 1), (1, "0.2", 2), (1, "2.0", 3), (2, "0.0", 4)]


def test_shared_and_recursive_elements():
    graph = nested.build_graph([("p.node", "array"), ("p.node.node", "array"), ("q.node", "array"), ("p.node.v", "string"), ("p.node.v", "bigint")])
    assert graph.shared == {"node": ["p.node", "p.node.node", "q.node"]} and graph.recursive == ["p.node.node"]
    assert graph.columns["node"] == {"v": "string"} and set(graph.relation_of.values()) == {"node"}


def test_one_table_for_a_shared_and_recursive_element(spark):
    tree = {"v": 1, "node": [{"v": 2, "node": [{"v": 3, "node": {"v": 4, "node": [{"v": 5}]}}]}]}
    df = spark.createDataFrame([(1, json.dumps({"p": {"node": [tree]}, "q": {"node": [{"v": 9}]}}))], "row_id bigint, doc string")
    graph = nested.analyse(df, "doc")
    assert graph.relations == ["p.node", "p.node.node", "q.node"]
    rows = nested.shred(df, graph, "row_id", "doc")
    got = sorted((r.v, r.arr_path, r.ordinals, r.parent_path, r.parent_ordinals) for r in nested.relation_table(rows, graph, "node").collect())
    assert got == [
        (1, "p.node", "0", "", ""), (2, "p.node.node", "0.0", "p.node", "0"), (3, "p.node.node", "0.0.0", "p.node.node", "0.0"),
        (4, "p.node.node", "0.0.0.0", "p.node.node", "0.0.0"), (5, "p.node.node", "0.0.0.0.0", "p.node.node", "0.0.0.0"), (9, "q.node", "0", "", ""),
    ]


def test_any_depth(spark):
    def deep(n):
        return '{"b":' * n + '{"list":[{"x":7}]}' + "}" * n

    docs = [(1, deep(1)), (2, deep(300)), (3, deep(50_000)), (4, '{"a":' + "[" * 50_000 + "]" * 50_000 + "}"), (5, "[" * 50_000)]
    df = spark.createDataFrame(docs, "row_id bigint, doc string")
    graph = nested.analyse(df, "doc")
    assert graph.relations == ["b.b.list", "b.list"]
    rows = nested.shred(df, graph, "row_id", "doc")
    assert sorted((r.rec_id, r.arr_path, r.ordinals, r.row_json) for r in rows.collect()) == [(1, "b.list", "0", '{"x": 7}'), (2, "b.b.list", "0", '{"x": 7}'), (3, "b.b.list", "0", '{"x": 7}')]
    wide = {"l" + str(i): {"list": [{"x": i}]} for i in range(3)}
    for n in range(300):
        wide = {f"k{n}": wide}
    got = nested.Facts()
    got.add(wide, "")
    assert sum(f == "array" for _, f in got.pairs) == 3


def test_deep_parser_agrees_with_the_library():
    texts = ['{"a": [1, -2.5e3, true, false, null, "x\\u00e9\\n"], "b": {}, "c": [], "a": 3}', "[]", " 5 ", '"s"', "[1,]", "{,}", '{"a" 1}', "[1 2]", "01", "nul", "", " ", "[1]]", "1 2", '{"a":1,}', "[NaN]", '["\t"]', "{1:2}", "[[[1],{}]]"]
    for t in texts:
        want = nested.parse(t)
        try:
            got = (nested.parse_deep(t), True)
        except ValueError:
            got = (None, False)
        assert got == want, t


def test_objects_with_many_names_are_maps(spark):
    docs = [(i, json.dumps({"users": {f"u{i}-{j}": {"age": j, "items": [{"n": j}]} for j in range(20)}, "sizes": {f"s{i}{j}": j for j in range(20)}})) for i in range(80)]
    df = spark.createDataFrame(docs, "row_id bigint, doc string")
    graph = nested.analyse(df, "doc")
    assert graph.relations == ["users.*", "users.*.items"] and graph.maps == {"users", "sizes"}
    rows = nested.shred(df, graph, "row_id", "doc")
    users = nested.relation_table(rows, graph, "users.*")
    assert users.count() == 1600 and users.where("rec_id = 3 AND ordinals = '4'").select("`@key`", "age").first()[:] == ("u3-4", 4)
    items = nested.relation_table(rows, graph, "users.*.items").where("rec_id = 3 AND parent_ordinals = '4'").first()
    assert (items.ordinals, items.n, items.parent_path) == ("4.0", 4, "users.*") and graph.columns[""] == {"sizes": "string"}


def test_clashing_column_names_and_empty(spark):
    df = spark.createDataFrame([(1, '[{"rec_id": 5, "Ordinals": "x", "ordinals": "y"}]')], "row_id bigint, doc string")
    graph = nested.analyse(df, "doc", "root")
    out = nested.relation_table(nested.shred(df, graph, "row_id", "doc", "root"), graph, "root")
    assert len(set(c.lower() for c in out.columns)) == len(out.columns) and out.count() == 1
    none = spark.createDataFrame([], "row_id bigint, doc string")
    graph = nested.analyse(none, "doc", declared=["a.b"])
    assert graph.relations == ["a.b"] and nested.shred(none, graph, "row_id", "doc").collect() == []

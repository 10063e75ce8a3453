import random

import pytest

from tracequarry.operators import hierarchy as module
from tracequarry.operators.hierarchy import descendants, hierarchy

SCHEMA = "g bigint, v bigint, p bigint, name string, t int, root string"


def brute(rows):
    latest: dict = {}
    for g, v, p, name, t, *_ in rows:
        if g is not None and v is not None and ((g, v) not in latest or (-1 if t is None else t) >= latest[g, v][0]):
            latest[g, v] = (-1 if t is None else t, p, name or "")
    chains = {}
    for k in latest:
        chain, seen = [k], {k}
        while True:
            p = latest[chain[-1]][1]
            up = (k[0], p)
            if p is None or up == chain[-1] or up not in latest:
                break
            if up in seen:
                chain = None
                break
            chain.append(up)
            seen.add(up)
        chains[k] = chain
    below: dict = {}
    for chain in chains.values():
        for a in (chain or [])[1:]:
            below[a] = below.get(a, 0) + 1
    return {
        k: (-1, -1, -1, "") if c is None else (c[-1][1], len(c) - 1, below.get(k, 0), "\\".join(latest[x][2] for x in reversed(c)))
        for k, c in chains.items()
    }


def solve(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = hierarchy(df, "g", "v", "p", "name", ["t"], **options)
    return {(r[0], r[1]): tuple(r)[2:] for r in out.collect()}


def forest(seed, n, groups=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        kind = random.random()
        p = None if kind < 0.03 else i if kind < 0.06 else 10**6 + i if kind < 0.08 else random.randint(max(0, i - 3), min(n - 1, i + (2 if kind > 0.97 else 0)))
        rows.append((random.randint(1, groups), i, p, f"n{i}", 1))
    return rows


@pytest.mark.parametrize("cap", [250_000, 12])
def test_random_forests_with_cycles(spark, cap):
    rows = forest(1, 60 if cap < 100 else 600)
    assert solve(spark, rows, cap=cap) == brute(rows)


@pytest.mark.parametrize("cap", [250_000, 30])
def test_long_chain_ring_and_star(spark, cap):
    n = 80 if cap < 100 else 900
    rows = [(1, i, i - 1 if i else None, "c", 1) for i in range(n)]
    rows += [(2, i, (i + 1) % 40, "r", 1) for i in range(40)] + [(2, 100, 3, "below", 1), (2, 101, 100, "lower", 1)]
    rows += [(3, i, 0, f"s{i}", 1) for i in range(200)]
    assert solve(spark, rows, cap=cap) == brute(rows)


def test_latest_rows_nulls_and_repeats(spark):
    rows = [(1, 1, None, "a", 1), (1, 2, 1, "old", 1), (1, 2, 1, "new", 2), (1, 2, 1, "new", 2), (1, 3, 2, None, None), (None, 4, 1, "x", 1), (1, None, 1, "x", 1), (2, 2, 1, "b", 1)]
    got = solve(spark, rows)
    assert got == {(1, 1): (1, 0, 2, "a"), (1, 2): (1, 1, 1, "a\\new"), (1, 3): (1, 2, 0, "a\\new\\"), (2, 2): (2, 0, 0, "b")}


def test_empty(spark):
    assert solve(spark, []) == {}


def test_descendants(spark):
    rows = forest(5, 120)
    got = sorted(tuple(r) for r in descendants(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), "g", "v", "p", ["t"]).collect())
    latest = {(g, v): p for g, v, p, *_ in rows}
    want = []
    for (g, v), (root, depth, _, _) in brute(rows).items():
        at = v
        for d in range(1, depth + 1):
            at = latest[g, at]
            want.append((g, at, v, d))
    assert got == sorted(want)


def test_deep_chain_in_bounded_slices(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE_CHARACTERS", 50_000)
    n = 20_000
    df = spark.range(n).selectExpr("1L AS g", "id AS v", "CASE WHEN id > 0 THEN id - 1 END AS p", "'c' AS name")
    out = hierarchy(df, "g", "v", "p", "name").selectExpr("count(*) AS n", "sum(depth) AS d", "sum(n_desc) AS s", "sum(length(path)) AS l", "min(root) AS a", "max(root) AS b").first()
    assert tuple(out) == (n, n * (n - 1) // 2, n * (n - 1) // 2, n * n, 0, 0)


def test_group_of_300_000_nodes_over_the_cluster(spark):
    """A group above the cap: eight children each, and a chain and a ring beside."""
    n = 300_000
    df = spark.range(n).selectExpr("1L AS g", "id AS v", "CASE WHEN id > 0 THEN (id - 1) DIV 8 END AS p", "'x' AS name")
    chain = spark.range(n, n + 500).selectExpr("1L AS g", "id AS v", f"CASE WHEN id = {n} THEN 7L ELSE id - 1 END AS p", "'y' AS name")
    ring = spark.range(n + 1000, n + 1100).selectExpr("1L AS g", "id AS v", f"CASE WHEN id = {n + 1099} THEN {n + 1000}L ELSE id + 1 END AS p", "'z' AS name")
    df = df.unionByName(chain).unionByName(ring)
    measures = ["count(*) AS n", "sum(depth) AS d", "sum(n_desc) AS s", "sum(length(path)) AS l", "sum(crc32(path)) AS h"]
    by_joins = hierarchy(df, "g", "v", "p", "name", cap=250_000).selectExpr(*measures).first()
    in_task = hierarchy(df, "g", "v", "p", "name", cap=10**7).selectExpr(*measures).first()
    assert by_joins == in_task and by_joins[0] == n + 600

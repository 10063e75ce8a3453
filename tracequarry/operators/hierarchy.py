"""Parent-child links to full hierarchies (problem 6).

Tree contraction. Leaves are raked into their parents and nodes of unary chains are
spliced out, in alternation, which removes a constant share of any forest's nodes per
round, however deep it is; every removal is recorded. What cannot be contracted is a
cycle: it shrinks to a node that is its own parent. The recorded removals are then
replayed in reverse, so that every node gets root, depth, path and number of
descendants from nodes that are already known.

Groups (such as disk volumes) of at most ``cap`` nodes are contracted inside one task with
array arithmetic, many groups per batch. Larger groups are first contracted over the
cluster by joins until no group has more than ``cap`` active nodes; the results are the same.

Paths come from the records, too: a removed node keeps the label that its link had gathered
and the node it hung under, which was removed later or not at all, so that a path is put
together from as many pieces as there were rounds, for a bounded slice of nodes at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.runtime import cut_lineage, many_columns

#: Most active nodes of one group that a task contracts by itself.
CAP = 250_000
#: Rows gathered before a batch of whole groups is contracted.
BATCH = 50_000
#: Characters of paths, and nodes, that are put together and passed on at once.
SLICE_CHARACTERS, SLICE_NODES = 16_000_000, 10_000
_STATE = "g bigint, v bigint, p bigint, w bigint, lab string, acc bigint, carry bigint, cyc boolean"
_RESULT = "g bigint, v bigint, root bigint, depth bigint, n_desc bigint, path string, cyc boolean"


def contract(parent: np.ndarray, w: np.ndarray, acc: np.ndarray, carry: np.ndarray, cyc: np.ndarray, lab: np.ndarray):
    """Contracts a forest given by parent positions (-1: root) and replays it.

    ``w``: edges that a link stands for; ``acc``: descendants already raked into a node;
    ``carry``: nodes that the link itself stands for; ``cyc``: roots that are cycles;
    ``lab``: the names that the link and its node stand for.
    Returns root position, depth, number of descendants and whether a node is on or below
    a cycle (its other results are then without meaning); and for the paths of each node the
    one it hung under when it was removed (-1: none), its label then, and the path's length.
    """
    n = len(parent)
    p, w, acc, carry, cyc, lab = parent.copy(), w.copy(), acc.copy(), carry.copy(), cyc.copy(), lab.copy()
    children = np.bincount(p[p >= 0], minlength=n)
    active = np.ones(n, dtype=bool)
    records: list[tuple] = []
    coins = np.random.default_rng(7)
    rest = np.arange(n)
    hung = np.full(n, -1, dtype=np.int64)
    while True:
        leaves = rest[(children[rest] == 0) & (p[rest] >= 0)]
        while len(leaves):  # rake, following the leaves that raking makes
            up = p[leaves]
            records.append((leaves, up, w[leaves], None, None))
            hung[leaves] = up
            np.add.at(acc, up, acc[leaves] + 1 + carry[leaves])
            np.subtract.at(children, up, 1)
            active[leaves] = False
            if len(leaves) * 4 < len(rest):
                break  # little to rake at once: a chain, which compressing shortens faster
            new = np.unique(up)
            leaves = new[(children[new] == 0) & (p[new] >= 0)]
        rest = rest[active[rest]]
        links = rest[p[rest] >= 0]
        if not len(links):
            break
        # compress: the child decides, so that each removed node has one child and a parent that stay
        coin = coins.random(n) < 0.5
        mid = p[links]
        go = (children[mid] == 1) & (p[mid] >= 0) & coin[mid] & ~coin[links] & (mid != links)
        child = links[go]
        mid = p[child]
        if len(child):
            records.append((mid, p[mid], w[mid], child, carry[child].copy()))
            hung[mid] = p[mid]
            carry[child] += acc[mid] + 1 + carry[mid]
            w[child] += w[mid]
            lab[child] = lab[mid] + "\\" + lab[child]
            p[child] = p[mid]
            active[mid] = False
        loops = rest[active[rest] & (p[rest] == rest)]
        if len(loops):  # a cycle has shrunk to one node
            cyc[loops] = True
            children[loops] -= 1
            p[loops] = -1
        rest = rest[active[rest]]
    root, depth, size = np.arange(n), np.zeros(n, dtype=np.int64), acc
    length = np.fromiter(map(len, lab), dtype=np.int64, count=n)
    for v, up, weight, child, carried in reversed(records):
        root[v], depth[v], cyc[v] = root[up], depth[up] + weight, cyc[up]
        length[v] += length[up] + 1
        if child is not None:
            size[v] = acc[v] + carried + 1 + size[child]
    return root, depth, size, cyc, hung, lab, length


def paths_of(nodes: np.ndarray, hung: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """The paths of some nodes, from the labels of the records they lead to."""
    out, at = lab[nodes], hung[nodes]
    going = np.flatnonzero(at >= 0)
    while len(going):
        up = at[going]
        out[going] = lab[up] + "\\" + out[going]
        at[going] = hung[up]
        going = going[at[going] >= 0]
    return out


def _emit(t) -> Iterator:
    """Results of one Arrow table of whole groups, a slice of nodes at a time."""
    import pyarrow as pa

    g, v = t.column("g").to_numpy(), t.column("v").to_numpy()
    n = len(g)
    order = np.lexsort((v, g))
    has = t.column("p").is_valid().to_numpy(zero_copy_only=False)
    p = t.column("p").fill_null(0).to_numpy()
    code = np.unique(g, return_inverse=True)[1]
    ids = np.unique(np.concatenate([v, p]))
    width = len(ids) + 1
    own = code * width + np.searchsorted(ids, v)
    want = code * width + np.searchsorted(ids, p)
    sorted_own = own[order]
    at = np.minimum(np.searchsorted(sorted_own, want), n - 1)
    parent = np.where(has & (sorted_own[at] == want), order[at], -1)
    parent[parent == np.arange(n)] = -1  # its own parent: a root
    lab = np.empty(n, dtype=object)
    lab[:] = t.column("lab").to_pylist()
    numbers = (t.column(c).to_numpy().copy() for c in ("w", "acc", "carry"))
    root, depth, size, cyc, hung, lab, length = contract(parent, *numbers, t.column("cyc").to_numpy(zero_copy_only=False).copy(), lab)
    length[cyc] = 0
    step = np.maximum(np.cumsum(length) // SLICE_CHARACTERS, np.arange(n) // SLICE_NODES)
    for s in np.split(np.arange(n), np.flatnonzero(np.diff(step)) + 1):
        paths = np.full(len(s), None, dtype=object)
        fine = ~cyc[s]
        paths[fine] = paths_of(s[fine], hung, lab)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g[s]), pa.array(v[s]), pa.array(v[root[s]]), pa.array(depth[s]), pa.array(size[s]), pa.array(paths, pa.string()), pa.array(cyc[s])],
            names=["g", "v", "root", "depth", "n_desc", "path", "cyc"],
        )


def solve_locally(state: DataFrame) -> DataFrame:
    """Contracts whole groups inside tasks; every group must be of at most ``CAP`` nodes or so."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < BATCH:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from _emit(t.slice(0, cut))
                rest = t.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from _emit(pa.Table.from_batches(held))

    return state.repartition("g").sortWithinPartitions("g").mapInArrow(run, _RESULT)


def _coin(v: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(v, F.lit(salt)), F.lit(2)) == 1


def _rake(state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records of raked leaves, results of roots without children left, remaining state)."""
    gains = (
        state.where(F.col("p").isNotNull())
        .groupBy("g", F.col("p").alias("v"))
        .agg(F.count("*").alias("kids"))
    )
    marked = cut_lineage(state.join(gains, ["g", "v"], "left"))
    leaf = F.col("kids").isNull() & F.col("p").isNotNull()
    alone = F.col("kids").isNull() & F.col("p").isNull()
    done = marked.where(alone).select(
        "g", "v", F.col("v").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.col("acc").alias("n_desc"), F.when(~F.col("cyc"), F.col("lab")).alias("path"), "cyc"
    )
    raked = marked.where(leaf).drop("kids")
    added = raked.groupBy("g", F.col("p").alias("v")).agg(F.sum(F.col("acc") + 1 + F.col("carry")).alias("more"))
    kept = marked.where(~leaf & ~alone).drop("kids").join(added, ["g", "v"], "left")
    return raked.withColumn("child", F.lit(None).cast("bigint")).withColumn("carried", F.lit(None).cast("bigint")), done, kept.select(
        "g", "v", "p", "w", "lab", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), "carry", "cyc"
    )


def _compress(state: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(records of spliced nodes, remaining state)."""
    only = (
        state.where(F.col("p").isNotNull() & (F.col("p") != F.col("v")))
        .groupBy("g", F.col("p").alias("v"))
        .agg(F.count("*").alias("kids"), F.min("v").alias("child"), F.min("carry").alias("carried"))
        .where((F.col("kids") == 1) & _coin(F.col("v"), salt) & ~_coin(F.col("child"), salt))
        .drop("kids")
    )
    spliced = cut_lineage(state.where(F.col("p").isNotNull()).join(only, ["g", "v"]))
    gone = spliced.select("g", "v", F.lit(True).alias("gone"))
    bridge = spliced.select(
        "g", F.col("child").alias("v"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("lab").alias("lab2"), (F.col("acc") + 1 + F.col("carry")).alias("c2")
    )
    kept = state.join(gone, ["g", "v"], "left").where(F.col("gone").isNull()).drop("gone").join(bridge, ["g", "v"], "left")
    moved = F.col("p2").isNotNull()
    parent = F.when(moved, F.col("p2")).otherwise(F.col("p"))
    loop = parent == F.col("v")
    return spliced, kept.select(
        "g",
        "v",
        F.when(~F.coalesce(loop, F.lit(False)), parent).alias("p"),
        (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
        F.when(moved, F.concat("lab2", F.lit("\\"), "lab")).otherwise(F.col("lab")).alias("lab"),
        "acc",
        (F.col("carry") + F.coalesce("c2", F.lit(0))).alias("carry"),
        (F.col("cyc") | F.coalesce(loop, F.lit(False))).alias("cyc"),
    )


def _replay(known: DataFrame, records: DataFrame) -> DataFrame:
    """Results of the records' nodes from results of their parents and children."""
    up = known.select("g", F.col("v").alias("p"), "root", "depth", "path", F.col("cyc").alias("up_cyc"))
    below = known.select("g", F.col("v").alias("child"), F.col("n_desc").alias("below"))
    got = records.drop("cyc").join(up, ["g", "p"]).join(below, ["g", "child"], "left")
    return got.select(
        "g",
        "v",
        "root",
        (F.col("depth") + F.col("w")).alias("depth"),
        (F.col("acc") + F.when(F.col("child").isNull(), F.lit(0)).otherwise(F.col("carried") + 1 + F.col("below"))).alias("n_desc"),
        F.when(~F.col("up_cyc"), F.concat("path", F.lit("\\"), "lab")).alias("path"),
        F.col("up_cyc").alias("cyc"),
    )


def solve(state: DataFrame, cap: int = CAP, max_rounds: int = 200) -> DataFrame:
    """Results of all groups; groups above ``cap`` are first contracted over the cluster.

    A round of raking and compressing leaves at most a constant share of the nodes active.
    The replay of a round reads the results of the nodes that were active after it, which
    all later rounds together have written, and writes only those of its own nodes: over all
    rounds that is a few times the number of nodes."""
    state = cut_lineage(state)  # read twice: for the sizes of the groups and for the work
    sizes = state.groupBy("g").agg(F.count("*").alias("n"))
    big = cut_lineage(sizes.where(F.col("n") > cap).select("g"))
    if big.isEmpty():
        return solve_locally(state)
    small = solve_locally(state.join(big, "g", "left_anti"))
    present = state.join(big, "g", "left_semi").select("g", F.col("v").alias("p"), F.lit(True).alias("there"))
    active = state.join(big, "g", "left_semi").join(present, ["g", "p"], "left")
    linked = F.col("there").isNotNull() & (F.col("p") != F.col("v"))
    active = cut_lineage(active.withColumn("p", F.when(linked, F.col("p"))).select(*[c.split()[0] for c in _STATE.split(", ")]))
    records: list[tuple[DataFrame, DataFrame]] = []
    finished: list[DataFrame] = []
    for salt in range(max_rounds):
        raked, done, active = _rake(active)
        active = cut_lineage(active)
        spliced, active = _compress(active, salt)
        active = cut_lineage(active)
        finished.append(done)
        records.append((raked, spliced))
        if active.groupBy("g").count().where(F.col("count") > cap).isEmpty():
            break
    else:
        raise RuntimeError(f"contraction did not end in {max_rounds} rounds")
    known = cut_lineage(solve_locally(active))
    for (raked, spliced), done in zip(reversed(records), reversed(finished)):
        known = known.unionByName(done)  # roots that this round finished, the parents of leaves it raked
        known = known.unionByName(cut_lineage(_replay(known, spliced)))
        known = known.unionByName(cut_lineage(_replay(known, raked)))
    return small.unionByName(known)


@many_columns()
def hierarchy(
    rows: DataFrame, group: str, node: str, parent: str, name: str, order: Sequence[str] = (), cap: int = CAP
) -> DataFrame:
    """Root, depth, number of descendants and path of every node.

    One row per (group, node), taken from its latest row by ``order`` (null sorts lowest;
    exact repeats collapse). A root has a null parent, itself as parent, or one that is
    absent from the group; its depth is 0. Paths join names with a backslash; a null name
    counts as empty. Nodes on a cycle or below one get -1 for root, depth and descendants
    and an empty path. Rows with a null group or node are left out; an empty table gives no
    rows; other columns are ignored, whatever their names.
    Returns group, node, root, depth, n_desc and path.
    """
    picked = rows.where(F.col(group).isNotNull() & F.col(node).isNotNull()).select(
        F.col(group).cast("bigint").alias("g"),
        F.col(node).cast("bigint").alias("v"),
        F.struct(*[F.col(c) for c in order], F.col(parent).cast("bigint").alias("__p"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("__n")).alias("__r"),
    )
    latest = picked.groupBy("g", "v").agg(F.max("__r").alias("__r"))
    zero = F.lit(0).cast("bigint")
    state = latest.select(
        "g", "v", F.col("__r.__p").alias("p"), F.lit(1).cast("bigint").alias("w"), F.col("__r.__n").alias("lab"), zero.alias("acc"), zero.alias("carry"), F.lit(False).alias("cyc")
    )
    out = solve(state, cap)
    bad = F.col("cyc")
    none = F.lit(-1).cast("bigint")
    return out.select(
        F.col("g").alias(group),
        F.col("v").alias(node),
        F.when(bad, none).otherwise(F.col("root")).alias("root"),
        F.when(bad, none).otherwise(F.col("depth")).alias("depth"),
        F.when(bad, none).otherwise(F.col("n_desc")).alias("n_desc"),
        F.when(bad, F.lit("")).otherwise(F.col("path")).alias("path"),
    )


def descendants(rows: DataFrame, group: str, node: str, parent: str, order: Sequence[str] = (), cap: int = CAP) -> DataFrame:
    """(group, ancestor, node, distance) for every node and each of its ancestors.

    The paths of :func:`hierarchy` over ids instead of names, taken apart in the JVM; there
    are as many rows as the sum of all depths. Nodes on or below a cycle give none."""
    ids = hierarchy(rows.withColumn("__id", F.col(node).cast("bigint").cast("string")), group, node, parent, "__id", order, cap)
    split = ids.where(F.col("depth") > 0).select(group, node, "depth", F.split("path", r"\\").alias("__ids"))
    exploded = split.select(group, node, "depth", F.posexplode(F.slice("__ids", F.lit(1), F.col("depth").cast("int"))).alias("__i", "__a"))
    return exploded.select(group, F.col("__a").cast("bigint").alias("ancestor"), node, (F.col("depth") - F.col("__i")).cast("int").alias("distance"))

"""Filling containers of fixed capacity with texts of varying length (problem 8).

A grouping genetic algorithm (the genes are whole containers). Crossover injects the best
filled containers of one parent into the other, full ones first, removes those that hold an
item twice, and puts the displaced items back: first by replacement (one or two displaced
items take the place of one or two smaller ones wherever that fills a container better),
then by best fit. Mutation dissolves some of the emptiest containers the same way.

Items are dealt at random into blocks of bounded size. A block whose best-fit packing
already needs no more containers than its sizes allow (their sum over the capacity, rounded
up) is solved: nothing can be better. The other blocks are bred by several islands in
parallel, which after every epoch pass their elite on to the next island, until the bound is
met or the epochs end. Poorly filled containers of the blocks are dissolved and packed again
together, level by level, until one block holds what is left.

An item is never split unless it exceeds the capacity: then it fills whole containers of
its own and only its remainder is packed with others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.tokens import FOLDER, token_counts
from tracequarry.runtime import cut_lineage

Bins = list[list[int]]
#: Most items of a bin among which pairs are tried for replacement; single items are always tried.
PAIRED = 24


def best_fit(sizes: list[int], items: Iterable[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the fullest bin that has room; changes ``bins`` and ``room``."""
    open_bins = sorted((r, i) for i, r in enumerate(room) if r > 0)
    for item in sorted(items, key=lambda x: (-sizes[x], x)):
        size = sizes[item]
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            left, i = open_bins.pop(at)
            bins[i].append(item)
        else:
            left, i = capacity, len(bins)
            bins.append([item])
            room.append(capacity)
        room[i] = left - size
        if room[i]:
            insort(open_bins, (room[i], i))


def quality(sizes: list[int], bins: Bins, capacity: int) -> float:
    """The mean squared fill: higher with fewer and fuller bins."""
    return sum((sum(sizes[x] for x in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def replace(sizes: list[int], displaced: list[int], bins: Bins, room: list[int], capacity: int, draw: np.random.Generator) -> list[int]:
    """Displaced items take the place of smaller ones where that fills a bin better; returns what is then displaced.

    For every bin with room, in random order: the pair of displaced items, or the one, that
    fits best in place of one or two of its items. Fills only grow, so this ends."""
    free = sorted((sizes[x], x) for x in displaced)
    for i in draw.permutation(len(bins)).tolist():
        if not room[i] or not free:
            continue
        held = bins[i]
        outs = [(sizes[x], (x,)) for x in held] + [(sizes[x] + sizes[y], (x, y)) for k, x in enumerate(held[:PAIRED]) for y in held[k + 1 : PAIRED]]
        best = (0, (), ())
        for out_size, out in outs:
            limit = out_size + room[i]
            at = bisect_left(free, (limit + 1, -1)) - 1
            if at >= 0 and free[at][0] - out_size > best[0]:
                best = (free[at][0] - out_size, out, (at,))
            low, high = 0, len(free) - 1
            while low < high:  # the pair with the largest sum within the limit
                got = free[low][0] + free[high][0]
                if got > limit:
                    high -= 1
                    continue
                if got - out_size > best[0]:
                    best = (got - out_size, out, (low, high))
                low += 1
            if best[0] == room[i]:
                break
        gain, out, taken = best
        if gain:
            items = [free[t][1] for t in taken]
            for t in sorted(taken, reverse=True):
                del free[t]
            bins[i] = [x for x in held if x not in out] + items
            room[i] -= gain
            for x in out:
                insort(free, (sizes[x], x))
    return [x for _, x in free]


def _restore(sizes: list[int], displaced: list[int], bins: Bins, capacity: int, draw: np.random.Generator) -> Bins:
    """``bins`` with the displaced items back: by replacement, then by best fit."""
    room = [capacity - sum(sizes[x] for x in b) for b in bins]
    best_fit(sizes, replace(sizes, displaced, bins, room, capacity, draw), bins, room, capacity)
    return bins


def crossover(sizes: list[int], a: Bins, b: Bins, capacity: int, draw: np.random.Generator) -> Bins:
    """``a`` with ``b``'s best filled bins, full ones first: duplicates out, displaced items back."""
    fills = [sum(sizes[x] for x in bin_) for bin_ in b]
    order = sorted(range(len(b)), key=lambda i: (-fills[i], draw.random()))
    take = order[: int(draw.integers(1, max(2, len(b) // 2 + 1)))]
    bins = [list(b[i]) for i in take]
    held = {x for bin_ in bins for x in bin_}
    displaced: list[int] = []
    for bin_ in a:
        if held.isdisjoint(bin_):
            bins.append(list(bin_))
        else:
            displaced.extend(x for x in bin_ if x not in held)
    return _restore(sizes, displaced, bins, capacity, draw)


def mutate(sizes: list[int], a: Bins, capacity: int, draw: np.random.Generator) -> Bins:
    """Dissolves some of the emptiest bins and a few others, and puts their items back."""
    order = np.argsort([sum(sizes[x] for x in b) for b in a], kind="stable")
    out = set(order[: max(2, len(a) // 10)].tolist()) | set(draw.choice(len(a), size=max(1, len(a) // 20)).tolist())
    displaced = [x for i in out for x in a[i]]
    return _restore(sizes, displaced, [list(b) for i, b in enumerate(a) if i not in out], capacity, draw)


def bound(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer containers: the sum over the capacity, or the items above half of it."""
    return max(-(-sum(sizes) // capacity), sum(1 for s in sizes if 2 * s > capacity))


def evolve(sizes: list[int], seeds: list[Bins], capacity: int, offspring: int, keep: int, seed: int) -> tuple[list[Bins], int]:
    """One epoch of one island: the best ``keep`` individuals after ``offspring`` births, and the births made."""
    draw = np.random.default_rng(seed)
    least = bound(sizes, capacity)
    population = list(seeds)
    while len(population) < keep:  # newcomers: random order in two waves, best fit within each, then replacement
        items = draw.permutation(len(sizes)).tolist()
        bins, room = [], []
        cut = len(items) * int(draw.integers(1, 10)) // 10
        best_fit(sizes, items[:cut], bins, room, capacity)
        population.append(_restore(sizes, items[cut:], bins, capacity, draw))
    rank = lambda b: (len(b), -quality(sizes, b, capacity))
    scored = sorted(((rank(b), i, b) for i, b in enumerate(population)), key=lambda x: x[:2])
    births = 0
    while births < offspring and len(scored[0][2]) > least:
        i, j = sorted(draw.integers(0, len(scored), size=2).tolist())
        child = crossover(sizes, scored[i][2], scored[j][2], capacity, draw) if i != j else mutate(sizes, scored[i][2], capacity, draw)
        births += 1
        if any(r == rank(child) for r, _, _ in scored):
            child = mutate(sizes, child, capacity, draw)  # a twin would only narrow the population
        scored.append((rank(child), len(population) + births, child))
        scored.sort(key=lambda x: x[:2])
        del scored[keep:]
    return [b for _, _, b in scored], births


def _labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for x in b:
            out[x] = k
    return out


def _bins(labels: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(labels.max()) + 1)] if len(labels) else []
    for x, k in enumerate(labels.tolist()):
        out[k].append(x)
    return [b for b in out if b]


def _seed(*numbers: int) -> int:
    """A random seed from numbers, the same in every process."""
    out = 0
    for n in numbers:
        out = (out * 1_000_003 + n) & 0x7FFFFFFF
    return out


def pack_blocks(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, offspring: int, keep: int, elite: int) -> DataFrame:
    """Packs every one of ``blocks`` blocks of ``items`` (block, id, n): adds ``bin``, numbered within the block.

    Items stay with their block; only labels (the bin of each item) pass between islands."""
    spark = items.sparkSession

    def first(batches: Iterable) -> Iterator:
        for pdf in batches:
            rows = []
            for sizes in pdf["sizes"]:
                sizes = [int(x) for x in sizes]
                bins: Bins = []
                best_fit(sizes, range(len(sizes)), bins, [], capacity)
                rows.append((_labels(bins, len(sizes)), len(bins) > bound(sizes, capacity)))
            yield pdf.assign(bins=[r[0] for r in rows], open=[r[1] for r in rows])

    gathered = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("__i"))
    gathered = gathered.select("block", F.col("__i.id").alias("ids"), F.col("__i.n").cast("array<int>").alias("sizes"))
    started = cut_lineage(gathered.repartition(_tasks(spark, blocks), "block").mapInPandas(first, "block bigint, ids array<bigint>, sizes array<int>, bins array<int>, open boolean"))
    unsolved = started.where("open").select("block", "sizes", "bins")
    n_open = unsolved.count()
    if n_open:
        bred = _breed(unsolved, n_open, capacity, islands, epochs, offspring, keep, elite)
        started = started.join(bred.withColumnRenamed("bins", "__bred"), "block", "left").withColumn("bins", F.coalesce("__bred", "bins"))
    flat = started.select("block", F.explode(F.arrays_zip("ids", "sizes", "bins")).alias("__x"))
    return flat.select("block", F.col("__x.ids").alias("id"), F.col("__x.sizes").alias("n"), F.col("__x.bins").alias("bin"))


def _tasks(spark, rows: int) -> int:
    """As many tasks as rows, up to four per core: every row is seconds of work, so bytes must not decide."""
    return max(1, min(rows, 4 * spark.sparkContext.defaultParallelism))


def _breed(unsolved: DataFrame, n_open: int, capacity: int, islands: int, epochs: int, offspring: int, keep: int, elite: int) -> DataFrame:
    """The best packing (block, bins) of each unsolved block (block, sizes, bins)."""
    spark = unsolved.sparkSession
    schema = "block bigint, island int, elites array<array<int>>, met boolean"

    def epoch(state: DataFrame, number: int) -> DataFrame:
        def run(batches: Iterable) -> Iterator:
            for pdf in batches:
                out, met = [], []
                for row in pdf.itertuples(index=False):
                    sizes = [int(x) for x in row.sizes]
                    seeds = [_bins(np.asarray(e)) for e in row.elites]
                    best, _ = evolve(sizes, seeds, capacity, offspring, keep, _seed(int(row.block), int(row.island), number))
                    out.append([_labels(b, len(sizes)) for b in best[:elite]])
                    met.append(len(best[0]) <= bound(sizes, capacity))
                yield pdf[["block", "island"]].assign(elites=out, met=met)

        held = state.join(unsolved.select("block", "sizes"), "block")
        return cut_lineage(held.repartition(_tasks(spark, n_open * islands), "block", "island").mapInPandas(run, schema))

    state = unsolved.select("block", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"), F.array("bins").alias("elites"))
    finished: list[DataFrame] = []
    for number in range(epochs):
        state = epoch(state, number)
        done = state.groupBy("block").agg(F.max("met").alias("done")).where("done").select("block")
        if number + 1 == epochs:
            break
        finished.append(state.join(done, "block", "left_semi"))
        going = state.join(done, "block", "left_anti")
        if going.isEmpty():
            state = None
            break
        # elite migration around the ring of each block's islands
        guests = going.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, max(1, elite // 2)).alias("guests"))
        state = going.join(guests, ["block", "island"]).select("block", "island", F.concat("elites", "guests").alias("elites"))
    if state is not None:
        finished.append(state)
    every = finished[0].select("block", "island", F.element_at("elites", 1).alias("bins"))
    for f in finished[1:]:
        every = every.unionByName(f.select("block", "island", F.element_at("elites", 1).alias("bins")))
    best = every.groupBy("block").agg(F.min(F.struct(F.array_max("bins").alias("k"), "island", "bins")).alias("__b"))
    return best.select("block", F.col("__b.bins").alias("bins"))


def pack(
    sizes: DataFrame,
    capacity: int = 2048,
    key: str = "doc_id",
    size: str = "n_tokens",
    block_items: int = 2_000,
    islands: int = 4,
    epochs: int = 4,
    offspring: int = 40,
    keep: int = 12,
    elite: int = 4,
    good_fill: float = 0.985,
) -> DataFrame:
    """Containers for all items.

    ``key`` must be a bigint that is unique among the rows of size above 0; rows with a
    null key are left out, and rows of null size or size 0 take no space and get no
    container. Returns bin_id (text: level, block and number in the block), ``key``, piece (0 unless the item was split),
    first (position in the item of the piece's first unit) and ``size`` (of the piece). No
    container exceeds ``capacity``. ``good_fill`` is the fill under which a container of
    one level is dissolved and packed again with those of other blocks at the next. Levels
    go on while each leaves at most half of its items to the next; if more are left, most
    containers cannot be filled well, and dealing them anew would only repeat the level.
    """
    rows = sizes.select(F.col(key).cast("bigint").alias("id"), F.col(size).cast("bigint").alias("n")).where(F.col("id").isNotNull() & (F.col("n") > 0))
    rows = cut_lineage(rows)
    cap = F.lit(capacity).cast("bigint")
    whole = F.floor(F.col("n") / cap).cast("int")
    full = rows.where(F.col("n") >= capacity).select("id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select(
        F.lit(0).alias("level"), F.col("id").alias("block"), F.col("piece").alias("bin"), "id", "piece", (F.col("piece") * cap).alias("first"), cap.alias("n")
    )
    rest = rows.select("id", whole.alias("piece"), (whole * cap).alias("first"), (F.col("n") % cap).alias("n")).where(F.col("n") > 0)
    placed, pending = [full], rest.select("id", "n")
    count = pending.count()
    level = 0
    while count:
        level += 1
        blocks = -(-count // block_items)
        dealt = pending.withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(blocks)))
        packed = cut_lineage(pack_blocks(dealt, blocks, capacity, islands, epochs, offspring, keep, elite))
        if blocks == 1:
            placed.append(packed.withColumn("level", F.lit(level)))
            break
        poor = packed.groupBy("block", "bin").agg(F.sum("n").alias("fill")).where(F.col("fill") < good_fill * capacity).select("block", "bin")
        left = cut_lineage(packed.join(poor, ["block", "bin"], "left_semi"))
        before, count = count, left.count()
        if 2 * count > before:
            placed.append(packed.withColumn("level", F.lit(level)))
            break
        placed.append(packed.join(poor, ["block", "bin"], "left_anti").withColumn("level", F.lit(level)))
        pending = left.select("id", F.col("n").cast("bigint").alias("n"))
    pieces = placed[1].select("level", "block", "bin", "id", "n") if len(placed) > 1 else None
    for p in placed[2:]:
        pieces = pieces.unionByName(p.select("level", "block", "bin", "id", "n"))
    out = full
    if pieces is not None:
        out = out.unionByName(pieces.join(rest.select("id", "piece", "first"), "id").select("level", "block", "bin", "id", "piece", "first", F.col("n").cast("bigint").alias("n")))
    return out.select(
        F.concat_ws("-", "level", "block", "bin").alias("bin_id"), F.col("id").alias(key), "piece", "first", F.col("n").alias(size)
    )


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, **options) -> DataFrame:
    """Containers of ``capacity`` tokens for all texts; see :func:`pack`."""
    return pack(token_counts(documents, vocabulary, folder=folder), capacity, **options)

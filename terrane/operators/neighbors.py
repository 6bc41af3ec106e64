"""Neighbour searches, orderings and the graph of a sparse approximation.

Two ways for nearest neighbours. Up to SMALL locations, counted first, one side is broadcast. Beyond, candidates are cut at
medians into tiles of about as many points, however they are clustered; a point looks in its own tile, and then in
those that the circle of what it found reaches into. For neighbours among earlier points, points are searched by octaves of
their order, each among the candidates up to its end, at least half of which are earlier.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.talk import Talk
from terrane.sources import storage

#: Locations up to which a side may be broadcast.
SMALL = 20_000
#: Candidates of a tile, about; rows of a level's sample, which cuts its tiles, and tiles of a level at most.
TILE, SAMPLE, TILES = 4096, 1 << 18, 4096


def squared_distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return dx * dx + dy * dy


def coincident(points: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of rows of two sets at one place: a, b."""
    return points.select(F.col("loc_id").alias("a"), "x", "y").join(others.select(F.col("loc_id").alias("b"), "x", "y"), ["x", "y"]).select("a", "b")


def nearest(pairs: DataFrame, m: int) -> DataFrame:
    """Of pairs (node, parent, d2): the m nearest parents of each node, ties to the smaller id; k counts from 1."""
    k = F.row_number().over(Window.partitionBy("node").orderBy("d2", "parent"))
    return pairs.withColumn("k", k).filter(F.col("k") <= m).select("node", "parent", "k", F.sqrt("d2").alias("d"))


def ordered_knn(points: DataFrame, m: int, small: int = SMALL) -> DataFrame:
    """For each point (loc_id, x, y) its m nearest of those with a smaller loc_id, fewer where there are fewer."""
    if points.count() > small:
        return ordered_knn_cells(points, m)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are made, ranked and dropped where the node is
    a = points.select(F.col("loc_id").alias("node"), F.col("x").alias("ax"), F.col("y").alias("ay")).repartition(parts, "node")
    b = points.select(F.col("loc_id").alias("parent"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = a.join(F.broadcast(b), F.col("parent") < F.col("node")).select("node", "parent", squared_distance("a", "b").alias("d2"))
    return nearest(pairs, m)


def knn(points: DataFrame, new: DataFrame, m: int, small: int = SMALL) -> DataFrame:
    """For each row of new (loc_id, x, y) its m nearest points."""
    a = new.select(F.col("loc_id").alias("node"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(F.col("loc_id").alias("parent"), F.col("x").alias("bx"), F.col("y").alias("by"))
    if points.count() > small or points.count() * new.count() > small * small:
        return _by_tiles(a.withColumn("level", F.lit(0)), b.withColumn("levels", F.array(F.lit(0))), m, False)
    return nearest(a.crossJoin(F.broadcast(b)).select("node", "parent", squared_distance("a", "b").alias("d2")), m)


def ordered_knn_cells(points: DataFrame, m: int, block: int = TILE) -> DataFrame:
    """ordered_knn() by tiles, whatever the number of points."""
    rank = ranked(points)
    octave = F.floor(F.log2(F.col("ord") + 1)).cast("int")
    last = rank.agg(F.max(octave)).first()[0]
    if last is None:
        return nearest(points.select(F.col("loc_id").alias("node"), F.col("loc_id").alias("parent"), F.lit(0.0).alias("d2")).limit(0), m)
    a = rank.select(F.col("loc_id").alias("node"), F.col("x").alias("ax"), F.col("y").alias("ay"), octave.alias("level"))
    b = rank.select(F.col("loc_id").alias("parent"), F.col("x").alias("bx"), F.col("y").alias("by"), F.sequence(octave, F.lit(last)).alias("levels"))
    return _by_tiles(a, b, m, True, block)


def ranked(points: DataFrame, key: str = "loc_id") -> DataFrame:
    """points with ord, their rank by a key from 0: ranges are sorted apart, then counted on."""
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = storage.once(points.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "ranges")
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = rows.groupBy("part").count().select("part", ahead.alias("first"))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return rows.withColumn("nth", nth).join(F.broadcast(firsts), "part").withColumn("ord", F.col("first") + F.col("nth")).drop("part", "nth", "first")


class Cuts(NamedTuple):
    """A level's tiles: a tree of cuts at medians, each along the longer side. Node by node: axis, cut, children (below, above), tile or -1."""

    axis: np.ndarray
    at: np.ndarray
    below: np.ndarray
    above: np.ndarray
    tile: np.ndarray

    def tiles(self, xy: np.ndarray) -> np.ndarray:
        node = np.zeros(len(xy), np.int64)
        while len(live := np.flatnonzero(self.tile[node] < 0)):
            n = node[live]
            up = xy[live, self.axis[n]] > self.at[n]
            node[live] = np.where(up, self.above[n], self.below[n])
        return self.tile[node]


def cuts(sample: np.ndarray, tiles: int) -> Cuts:
    """Cuts a sample until there are so many tiles, or none can be cut."""
    rows: list[list[float]] = []
    count = 0
    todo = [(np.arange(len(sample)), tiles, -1, 0)]
    while todo:
        ids, want, parent, side = todo.pop()
        me = len(rows)
        if parent >= 0:
            rows[parent][2 + side] = me
        xy = sample[ids]
        axis = int(np.argmax(np.ptp(xy, axis=0))) if len(ids) else 0
        low = want // 2
        cut = float(np.partition(xy[:, axis], len(ids) * low // want - 1)[len(ids) * low // want - 1]) if want > 1 and len(ids) >= want else 0.0
        up = xy[:, axis] > cut if want > 1 and len(ids) >= want else np.zeros(0, bool)
        if not up.any():
            rows.append([0, 0.0, -1, -1, count])
            count += 1
            continue
        rows.append([axis, cut, -1, -1, -1])
        todo += [(ids[up], want - low, me, 1), (ids[~up], low, me, 0)]
    axis, at, below, above, tile = zip(*rows, strict=True)
    return Cuts(np.array(axis, int), np.array(at), np.array(below, int), np.array(above, int), np.array(tile, int))


def _nearest_of(nodes: np.ndarray, q: np.ndarray, far: np.ndarray, parents: np.ndarray, xy: np.ndarray, m: int, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its m nearest of some candidates that are not farther than far (squared): node, parent, d2; ties at the edge too."""
    out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(0, len(nodes), 512):
        own = slice(i, i + 512)
        dx, dy = q[own, 0, None] - xy[None, :, 0], q[own, 1, None] - xy[None, :, 1]
        d2 = dx * dx + dy * dy
        if ordered:
            d2[parents[None, :] >= nodes[own, None]] = np.inf
        edge = far[own].copy()
        if d2.shape[1] > m:
            edge = np.minimum(edge, np.partition(d2, m - 1, axis=1)[:, m - 1])
        a, b = np.nonzero((d2 <= edge[:, None]) & (d2 < np.inf))
        out.append((nodes[own][a], parents[b], d2[a, b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_tiles(a: DataFrame, b: DataFrame, m: int, ordered: bool, block: int = TILE) -> DataFrame:
    """Nearest parents of a (node, ax, ay, level) among b (parent, bx, by, levels).

    Each level's candidates are cut into tiles of about as many points, however they are clustered; a tile with more than twice `block` is
    dealt in blocks. A node looks in its own tile, and then in those that reach into the circle of what it found. Two passes; a task has one block.
    """
    spark = b.sparkSession
    levels = b.select("parent", "bx", "by", F.explode(F.col("levels").cast("array<int>")).alias("level"))
    sizes = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a level
    if not sizes:
        return nearest(a.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("d2")).limit(0), m)
    trees: dict[int, Cuts] = {}
    for level, n in sizes.items():
        want = max(1, min(TILES, -(-n // block)))
        rows = min(SAMPLE, 256 * want)
        own = levels.filter(F.col("level") == level)
        picked = own if n <= rows else own.filter(F.pmod(F.xxhash64("parent", F.lit(7)), F.lit(n)) < rows)  # about `rows` of them: SAMPLE, about
        trees[level] = cuts(np.array([(r["bx"], r["by"]) for r in picked.select("bx", "by").collect()]).reshape(-1, 2), want) if want > 1 else cuts(np.zeros((0, 2)), 1)
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            level, xy = t.column(3).to_numpy(), np.column_stack([t.column(1).to_numpy(), t.column(2).to_numpy()])
            tile = np.zeros(len(level), np.int32)
            for x in np.unique(level):
                tile[level == x] = shared.value[int(x)].tiles(xy[level == x])
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(tile)], [*t.schema.names, "tile"])

    held = storage.once(levels.mapInArrow(place, "parent bigint, bx double, by double, level int, tile int"), "candidates")
    boxes = held.groupBy("level", "tile").agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1"), F.count("*").alias("n")).collect()  # TILES rows a level at most
    told: dict[int, np.ndarray] = {x: np.array([(r["tile"], -(-r["n"] // (2 * block)), r["x0"], r["x1"], r["y0"], r["y1"]) for r in boxes if r["level"] == x]) for x in sizes}
    reach = spark.sparkContext.broadcast(told)
    many = [(r["level"], r["tile"], -(-r["n"] // (2 * block))) for r in boxes if r["n"] > 2 * block]
    dealt = held.withColumn("part", F.lit(0))
    if many:
        large = F.broadcast(spark.createDataFrame(many, "level int, tile int, parts int"))
        dealt = held.join(large, ["level", "tile"], "left").withColumn("part", F.pmod(F.xxhash64("parent"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def send(first: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for i in range(0, t.num_rows, 1024):
                    s = t.slice(i, 1024)
                    level, xy, far = s.column(3).to_numpy(), np.column_stack([s.column(1).to_numpy(), s.column(2).to_numpy()]), s.column(4).to_numpy()
                    to, tile, part = [], [], []
                    for x in np.unique(level):
                        at, box = np.flatnonzero(level == x), reach.value.get(int(x), np.zeros((0, 6)))
                        own = shared.value[int(x)].tiles(xy[at])[:, None] == box[None, :, 0] if len(box) else np.zeros((len(at), 0), bool)
                        if not first:
                            dx = np.maximum(np.maximum(box[None, :, 2] - xy[at, 0, None], xy[at, 0, None] - box[None, :, 3]), 0.0)
                            dy = np.maximum(np.maximum(box[None, :, 4] - xy[at, 1, None], xy[at, 1, None] - box[None, :, 5]), 0.0)
                            own = ~own & ((dx * dx + dy * dy) * (1 - 1e-12) <= far[at, None])
                        i_, j = np.nonzero(own)
                        parts = box[j, 1].astype(int)
                        to.append(np.repeat(at[i_], parts))
                        tile.append(np.repeat(box[j, 0], parts))
                        part.append(np.concatenate([np.arange(n) for n in parts]) if len(parts) else np.zeros(0))
                    pick = pa.array(np.concatenate(to))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pick) for c in s.columns), pa.array(np.concatenate(tile).astype(np.int32)), pa.array(np.concatenate(part).astype(np.int32))], ["node", "ax", "ay", "level", "far", "tile", "part"]
                    )

        return run

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            q, xy = (np.column_stack([t[c + "x"].to_numpy(), t[c + "y"].to_numpy()]) for t, c in ((left, "a"), (right, "b")))
            found = _nearest_of(left["node"].to_numpy(), q, left["far"].to_numpy(), right["parent"].to_numpy(), xy, m, ordered)
        return pa.table({"node": found[0], "parent": found[1], "d2": found[2]})

    def search(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.select("node", "ax", "ay", F.col("level").cast("int").alias("level"), "far").mapInArrow(send(first), "node bigint, ax double, ay double, level int, far double, tile int, part int")
        keys = ["level", "tile", "part"]
        return sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(solve, "node bigint, parent bigint, d2 double")

    near = storage.once(search(a.withColumn("far", F.lit(float("inf"))), True), "near")
    edge = near.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("d2", "parent"))).filter(F.col("nth") == m).select("node", F.col("d2").alias("far"))
    wide = a.join(edge, "node", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    return nearest(near.unionByName(search(wide, False)), m)


def grid_check(points: DataFrame, tolerance: float = math.sqrt(np.finfo(float).eps)) -> DataFrame:
    """One row: nx, ny, n, gridded: whether the points are all of a rectangle of equal steps in each direction.

    By aggregates only: each coordinate must be a whole number of mean steps from the first, all numbers being there.
    """
    size = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max), ("n", F.count_distinct))), F.count_distinct("x", "y").alias("n"))

    def nth(c: str) -> Column:
        step = (F.col(f"high_{c}") - F.col(f"low_{c}")) / (F.col(f"n_{c}") - 1)
        return F.when(F.col(f"n_{c}") > 1, F.round((F.col(c) - F.col(f"low_{c}")) / step)).otherwise(0.0)

    def off(c: str) -> Column:
        step = (F.col(f"high_{c}") - F.col(f"low_{c}")) / (F.col(f"n_{c}") - 1)
        return F.when(F.col(f"n_{c}") > 1, F.abs(F.col(c) - F.col(f"low_{c}") - nth(c) * step)).otherwise(0.0)

    every = points.crossJoin(F.broadcast(size))  # one row
    told = every.groupBy("n_x", "n_y", "n").agg(*(F.max(off(c)).alias(f"off_{c}") for c in "xy"), *(F.count_distinct(nth(c)).alias(f"there_{c}") for c in "xy"))
    even = (F.greatest("off_x", "off_y") <= tolerance) & (F.col("there_x") == F.col("n_x")) & (F.col("there_y") == F.col("n_y"))
    return told.select(F.col("n_x").alias("nx"), F.col("n_y").alias("ny"), "n", ((F.col("n_x") * F.col("n_y") == F.col("n")) & even).alias("gridded"))


def stencil(m: int) -> list[tuple[int, int]]:
    """Past offsets (dx, dy) for a grid in row order, nearest first, ties by dy, then dx."""
    r = 1
    while (2 * r + 1) ** 2 <= 3 * m + 1:
        r += 1
    every = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if (dy, dx) < (0, 0)]
    return sorted(every, key=lambda o: (o[0] ** 2 + o[1] ** 2, o[1], o[0]))


#: Steps that a tile of a grid is wide and tall.
SIDE = 64


def grid_parents(grid: DataFrame, m: int) -> DataFrame:
    """Parents on a grid (loc_id, gx, gy in steps): the m nearest past cells that exist, a row a node: node, parents (parent, k, dx, dy) by k.

    Cells are cut into square tiles. A tile gets the cells about it that its nodes may ask for, which are few, and each node's parents are found
    where it is: what is moved and sorted is a row or two a cell, not one for each offset.
    """
    steps = np.array(stencil(m)).reshape(-1, 2)
    reach = int(np.abs(steps).max(initial=0))
    side = max(SIDE, reach)
    cells = grid.select("loc_id", F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"))
    # Tiles of a cell: its own, and those above and beside it in which a node may have it as a parent.
    of = lambda c, off: F.floor((F.col(c) + off) / side).cast("int")
    tiles = F.array_distinct(F.array(*(F.struct(of("gx", i).alias("tx"), of("gy", j).alias("ty")) for i in (0, -reach, reach) for j in (0, reach))))
    dealt = cells.withColumn("tile", F.explode(tiles)).select("loc_id", "gx", "gy", "tile.tx", "tile.ty")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, x, y = (t[c].to_numpy().astype(np.int64) for c in ("loc_id", "gx", "gy"))
        x0, y0 = key[0].as_py() * side, key[1].as_py() * side
        tall = side + 2 * reach + 1
        place = (x - x0 + reach) * tall + (y - y0 + reach)
        order = np.lexsort((ids, place))
        place, there = place[order], ids[order]
        own = np.flatnonzero((x >= x0) & (x < x0 + side) & (y >= y0) & (y < y0 + side))
        want = ((x[own, None] + steps[:, 0] - x0 + reach) * tall + (y[own, None] + steps[:, 1] - y0 + reach)).ravel()
        first = np.searchsorted(place, want)
        count = np.searchsorted(place, want, "right") - first  # more than one where places share a cell
        which = np.repeat(np.arange(len(want)), count)
        parent = there[np.arange(len(which)) + np.repeat(first - (np.cumsum(count) - count), count)]
        node, o = np.divmod(which, len(steps))
        k = np.arange(len(node)) - np.searchsorted(node, node) + 1
        near = k <= m
        node, o, parent, k = node[near], o[near], parent[near], k[near]
        ends = np.searchsorted(node, np.arange(len(own) + 1)).astype(np.int32)
        fields = [pa.array(parent), pa.array(k.astype(np.int32)), pa.array(steps[o, 0].astype(np.int32)), pa.array(steps[o, 1].astype(np.int32))]
        return pa.table({"node": ids[own], "parents": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["parent", "k", "dx", "dy"]))})

    return dealt.groupBy("tx", "ty").applyInArrow(run, "node bigint, parents array<struct<parent: bigint, k: int, dx: int, dy: int>>")


def grid_dag(grid: DataFrame, m: int) -> DataFrame:
    """grid_parents() as edges: node, parent, k, dx, dy."""
    return grid_parents(grid, m).select("node", F.explode("parents").alias("p")).select("node", "p.parent", "p.k", "p.dx", "p.dy")


def node_patterns(dag: DataFrame) -> DataFrame:
    """node, pattern: its offsets to its parents, by k."""
    offset = F.concat_ws(",", F.col("dx").cast("string"), F.col("dy").cast("string"))
    return dag.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", offset.alias("o")))), lambda x: x["o"]), ";").alias("pattern"))


def grid_patterns(dag: DataFrame) -> DataFrame:
    """Nodes with the same offsets to their parents share factors: pattern, nodes, exemplar (the smallest node)."""
    return _by_pattern(node_patterns(dag))


def patterns_of(parents: DataFrame) -> DataFrame:
    """grid_patterns() of grid_parents(), whose rows have a node's offsets together already. Nodes without parents have no edges, and no pattern."""
    offset = lambda p: F.concat_ws(",", p["dx"].cast("string"), p["dy"].cast("string"))
    return _by_pattern(parents.filter(F.size("parents") > 0).select("node", F.array_join(F.transform("parents", offset), ";").alias("pattern")))


def _by_pattern(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("pattern").agg(F.count("*").alias("nodes"), F.min("node").alias("exemplar"))


def blanket(edges: DataFrame) -> DataFrame:
    """Markov blankets of a graph of edges (node, parent): parents, children and the children's other parents, sorted."""
    up = edges.select("node", F.col("parent").alias("member"))
    down = edges.select(F.col("parent").alias("node"), F.col("node").alias("member"))
    a = edges.select(F.col("node").alias("child"), F.col("parent").alias("node"))
    b = edges.select(F.col("node").alias("child"), F.col("parent").alias("member"))
    both = a.join(b, "child").filter("node != member").select("node", "member")
    return up.unionByName(down).unionByName(both).distinct().groupBy("node").agg(F.array_sort(F.collect_list("member")).alias("members"))


def greedy_colors(members: dict[int, list[int]]) -> dict[int, int]:
    """The lowest colour that no coloured member of the blanket has, in the order of nodes."""
    out: dict[int, int] = {}
    for node in sorted(members):
        used = {out[x] for x in members[node] if x in out}
        out[node] = next(c for c in range(len(used) + 1) if c not in used)
    return out


#: Nodes that a task colours, about.
COLOR_ROWS = 20_000


def coloring(blankets: DataFrame, tasks: int | None = None) -> DataFrame:
    """Greedy colours of blankets (node, members): node, color; each node's is the lowest that no earlier node of its blanket has.

    Nodes are dealt to tasks that run at once. A node is coloured as soon as all earlier ones of its blanket are; a task goes as far as it
    can, then tells the others its new colours. So the colours are those of one pass in the order of nodes.
    """
    spark = blankets.sparkSession
    parts = tasks or max(1, min(spark.sparkContext.defaultParallelism, -(-blankets.count() // COLOR_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk = Talk(TaskContext.get().partitionId())
        earlier: dict[int, list[int]] = {}
        for b in batches:
            earlier.update((n, [x for x in m if x < n]) for n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        waits = {n: len(m) for n, m in earlier.items()}
        asked: dict[int, list[int]] = {}
        for n, m in earlier.items():
            for x in m:
                asked.setdefault(x, []).append(n)
        color: dict[int, int] = {}
        fresh = [n for n, k in waits.items() if not k]
        while True:
            told: list[int] = []
            while fresh:
                n = fresh.pop()
                used = {color[x] for x in earlier[n]}
                color[n] = next(c for c in range(len(used) + 1) if c not in used)
                told += n, color[n]
                for child in asked.get(n, ()):
                    waits[child] -= 1
                    if not waits[child]:
                        fresh.append(child)
            every = talk.everyone(np.array(told, np.int64).tobytes())
            if not any(every):
                break
            for n, c in (pair for i, m in enumerate(every) if i != talk.tile for pair in np.frombuffer(m, np.int64).reshape(-1, 2).tolist()):
                if n in asked:
                    color[n] = c
                    for child in asked[n]:
                        waits[child] -= 1
                        if not waits[child]:
                            fresh.append(child)
        yield pa.RecordBatch.from_arrays([pa.array(list(earlier), pa.int64()), pa.array([color[n] for n in earlier], pa.int32())], ["node", "color"])

    return blankets.select("node", "members").repartition(parts, "node").mapInArrow(run, "node bigint, color int", barrier=True)


class Cells:
    """Points sorted by square cells, with each cell's largest value of near and the point that has it."""

    def __init__(self, xy: np.ndarray, near: np.ndarray, width: float):
        at = np.floor((xy - xy.min(0)) / width).astype(np.int64)
        tall = int(at[:, 1].max()) + 3  # a free cell above and below, so that a column's neighbours are its own
        key = (at[:, 0] + 1) * tall + at[:, 1] + 1
        self.width, self.order = width, np.argsort(key, kind="stable")
        self.x, self.y, self.near = xy[self.order, 0], xy[self.order, 1], near[self.order]
        self.place = np.empty(len(key), np.int64)
        self.place[self.order] = np.arange(len(key))
        names, first = np.unique(key[self.order], return_index=True)
        self.first = [*first.tolist(), len(key)]
        self.cell = np.empty(len(key), np.int64)
        self.cell[self.order] = np.repeat(np.arange(len(names)), np.diff(self.first))
        # The cells about each one, as three stretches of cells that follow one another.
        ends = [(np.searchsorted(names, names + i * tall - 1), np.searchsorted(names, names + i * tall + 1, "right")) for i in (-1, 0, 1)]
        self.about = [list(zip(a.tolist(), z.tolist(), strict=True)) for a, z in ends]
        self.top = [0.0] * len(names)
        self.heap: list[tuple[float, int, int]] = []
        for c in range(len(names)):
            self.renew(c)
        heapq.heapify(self.heap)

    def renew(self, c: int, push: bool = False) -> None:
        a, z = self.first[c], self.first[c + 1]
        own = self.near[a:z]
        at = int(own.argmax())  # the first of equals, as points of a cell keep their order
        self.top[c] = float(own[at])
        entry = (-self.top[c], int(self.order[a + at]), c)
        heapq.heappush(self.heap, entry) if push else self.heap.append(entry)

    def farthest(self) -> int:
        while True:
            value, point, _ = self.heap[0]
            if -value == self.near[self.place[point]]:  # else the entry is of before
                return point
            heapq.heappop(self.heap)

    def choose(self, point: int, x: float, y: float) -> None:
        c = self.cell[point]
        self.near[self.place[point]] = -1.0
        for about in self.about:
            low, high = about[c]
            if low == high:
                continue
            a, z = self.first[low], self.first[high]
            d = (self.x[a:z] - x) ** 2 + (self.y[a:z] - y) ** 2
            less = d < self.near[a:z]
            if less.any():
                np.copyto(self.near[a:z], d, where=less)
                for k in range(low, high):
                    if less[self.first[k] - a : self.first[k + 1] - a].any():
                        self.renew(k, True)
        self.renew(int(c), True)


def max_min_order(xy: np.ndarray) -> np.ndarray:
    """Farthest-point order: from the point nearest the centroid on, always the point farthest from all chosen; ties to the first.

    A point changes the distances of points within the largest one only, so it looks at the cells about it. Cells are made anew
    when that distance is half their width: all in all some n log n distances.
    """
    n = len(xy)
    order = np.empty(n, np.int64)
    order[0] = np.argmin(((xy - xy.mean(0)) ** 2).sum(1))
    near = ((xy - xy[order[0]]) ** 2).sum(1)
    near[order[0]] = -1.0
    cells: Cells | None = None
    for i in range(1, n):
        if cells is not None:
            point = cells.farthest()
            reach = cells.top[cells.cell[point]] ** 0.5
        if cells is None or reach < 0.5 * cells.width:
            if cells is not None:
                near[cells.order] = cells.near
            reach = max(near.max(), 0.0) ** 0.5
            if not reach:  # what is left lies on chosen points
                order[i:] = np.flatnonzero(near >= 0)
                break
            cells = Cells(xy, near, reach * (1 + 1e-9))
            point = cells.farthest()
        order[i] = point
        cells.choose(point, xy[point, 0], xy[point, 1])
    return order


def max_min(points: DataFrame) -> DataFrame:
    """loc_id and ord from 0 in max-min order, exact at any size. The rule is sequential: one task, which has the coordinates, and n log n steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("loc_id").reset_index(drop=True)
        order = max_min_order(pdf[["x", "y"]].to_numpy(float)) if len(pdf) else np.zeros(0, int)
        return pd.DataFrame({"loc_id": pdf["loc_id"].to_numpy()[order], "ord": np.arange(len(pdf))})

    return points.select("loc_id", "x", "y", F.lit(1).alias("task")).groupBy("task").applyInPandas(run, "loc_id bigint, ord bigint")


def level_order(points: DataFrame, last: int = 20) -> DataFrame:
    """loc_id and ord from 0, nearly in max-min order, by many tasks: only where it is asked for (order="levels"), at no size by itself.

    Level l cuts the points' box into 4 ** l cells. A point belongs to the first level at which it is the nearest of its cell
    to the cell's centre, and levels follow one another; so each prefix is spread over the whole. Within a level the order
    is that of a hash. Of ties the smaller id is taken. One aggregate over all levels, and a sort.
    """
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not box[4]:
        return points.select("loc_id", F.lit(0).cast("bigint").alias("ord")).limit(0)
    wide, tall = (max(box[1] - box[0], 1e-300), max(box[3] - box[2], 1e-300))
    levels = min(last, 2 + math.ceil(math.log(max(box[4], 2), 4)))
    each = points.select("loc_id", ((F.col("x") - box[0]) / wide).alias("u"), ((F.col("y") - box[2]) / tall).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    cell = [F.least(F.floor(F.col(c) * side), side - 1).alias(f"c{c}") for c in "uv"]
    off = lambda c: F.pow(F.col(c) * side - F.least(F.floor(F.col(c) * side), side - 1) - 0.5, F.lit(2.0))
    won = each.groupBy("level", *cell).agg(F.min(F.struct((off("u") + off("v")).alias("d2"), "loc_id"))["loc_id"].alias("loc_id"))
    own = points.select("loc_id").join(won.groupBy("loc_id").agg(F.min("level").alias("level")), "loc_id", "left")
    key = F.struct(F.coalesce("level", F.lit(levels + 1)).alias("level"), F.xxhash64("loc_id").alias("mark"), "loc_id")
    return ranked(own.select("loc_id", key.alias("key")), "key").select("loc_id", "ord")


def grid_steps(points: DataFrame) -> DataFrame:
    """Points (loc_id, x, y) of a full rectangle of equal steps with their column and row from 0: gx, gy. Others are refused."""
    if not grid_check(points).first()["gridded"]:
        raise ValueError("the places are not all of a grid of equal steps")
    low = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max), ("n", F.count_distinct))))
    nth = lambda c: F.when(F.col(f"n_{c}") > 1, F.round((F.col(c) - F.col(f"low_{c}")) * (F.col(f"n_{c}") - 1) / (F.col(f"high_{c}") - F.col(f"low_{c}")))).otherwise(0.0).cast("int")
    return points.crossJoin(F.broadcast(low)).select("loc_id", "x", "y", nth("x").alias("gx"), nth("y").alias("gy"))  # low is one row


def vecchia_dag(points: DataFrame, m: int, order: str = "maxmin") -> DataFrame:
    """The graph of a sparse approximation: edges (node, parent, k, d) by loc_id, parents being earlier in the order.

    order: maxmin, levels for one near it, id for the order of loc_id, or grid for rows of a grid: each node has the nearest past cells, counted in
    steps, as parents, and its offsets dx, dy to them follow d.
    """
    if order == "id":
        return ordered_knn(points, m)
    if order == "grid":
        at = storage.once(grid_steps(points), "grid")
        # Steps are equal, so a distance is that of its offsets: a step's width is that of the whole by the number of steps.
        wide = at.agg(*(F.coalesce((F.max(c) - F.min(c)) / F.nullif(F.max(f"g{c}"), F.lit(0)), F.lit(0.0)).alias(f"w{c}") for c in "xy"))
        off = lambda c: F.col(f"d{c}") * F.col(f"w{c}")
        edges = grid_dag(at, m).crossJoin(F.broadcast(wide))  # one row
        return edges.select("node", "parent", "k", F.sqrt(off("x") * off("x") + off("y") * off("y")).alias("d"), "dx", "dy")
    if order not in ("maxmin", "levels"):
        raise ValueError(f"no order {order}")
    by = storage.once((max_min if order == "maxmin" else level_order)(points).join(points, "loc_id"), "ordered")
    edges = ordered_knn(by.select(F.col("ord").alias("loc_id"), "x", "y"), m)
    named = by.select(F.col("ord").alias("o"), "loc_id")
    out = edges.join(named, edges["node"] == named["o"]).select(F.col("loc_id").alias("n"), "parent", "k", "d")
    return out.join(named, out["parent"] == named["o"]).select(F.col("n").alias("node"), F.col("loc_id").alias("parent"), "k", "d")

"""Sparse factors of a nearest-neighbour Gaussian process, and products with them.

For node i with parents P: h = C_PP^-1 C_Pi, r = sqrt(C_ii - C_iP h). H has 1 / r on the diagonal and -h / r at the
parents; H'H approximates the inverse of the correlation matrix. Factors are made in Arrow batches of nodes, all
systems of one size at once. Products are joins of entries with a vector and sums by row or column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.kernels import MATERN, Theta, covariance, distances
from terrane.operators import neighbors
from terrane.operators.talk import Talk
from terrane.sources import storage


def families(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its place and its parents and theirs, by k: node, x, y, nugget, parents, px, py, pn. Edges number m a node at most.

    nugget and pn: variances that places have for themselves, of points' column nugget; 0 without it.
    """
    own = points.select("loc_id", "x", "y", (F.coalesce("nugget", F.lit(0.0)) if "nugget" in points.columns else F.lit(0.0)).cast("double").alias("nugget"))
    places = own.select(F.col("loc_id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("nugget").alias("pn"))
    of_node = edges.select("node", "parent", "k").join(places, "parent").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "parent", "px", "py", "pn"))).alias("p"))
    rows = own.withColumnRenamed("loc_id", "node").join(of_node, "node", "left")
    kind = "array<struct<k: int, parent: bigint, px: double, py: double, pn: double>>"
    rows = rows.withColumn("p", F.coalesce(F.col("p").cast(kind), F.array().cast(kind)))
    return rows.select("node", "x", "y", "nugget", F.col("p.parent").alias("parents"), F.col("p.px").alias("px"), F.col("p.py").alias("py"), F.col("p.pn").alias("pn"))


def solve(places: np.ndarray, parents: np.ndarray, theta: Theta, family: int, nugget: float | np.ndarray = 0.0, theirs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """h (n, k) and r squared (n) for places (n, 2) and their parents' (n, k, 2). nugget: of the places, (n) or one for all; theirs: of the parents, (n, k)."""
    n, k = parents.shape[:2]
    total = theta.sigmasq + nugget
    if not k:
        return np.zeros((n, 0)), np.broadcast_to(total, n).astype(float)
    among = covariance(distances(parents, parents), theta, family)
    among[:, np.arange(k), np.arange(k)] = theta.sigmasq + (nugget if theirs is None else theirs)
    to = covariance(distances(places[:, None, :], parents), theta, family)[:, 0, :]
    try:
        h = np.linalg.solve(among, to[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError as e:
        raise ValueError("neighbours at one place, or too close, leave no factor") from e
    return h, total - (h * to).sum(1)


def factors(points: DataFrame, edges: DataFrame, thetas: Sequence[Theta], family: int = MATERN, nugget: float | Sequence[float] = 0.0) -> DataFrame:
    """Factors of every node for each outcome's theta, outcomes numbered from 1: outcome, node, sqrt_r, parents, h.

    nugget: variance that each place has for itself, beyond that of theta; one for all outcomes, or one for each. What points' column
    nugget says of a place, if there is one, comes on top.
    """
    nuggets = [float(nugget)] * len(thetas) if np.isscalar(nugget) else list(map(float, nugget))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["parents"].map(len).to_numpy()
            for k in np.unique(size):
                part = pdf[size == k]
                at = part[["x", "y"]].to_numpy(float)
                theirs = np.stack([np.stack(part["px"]), np.stack(part["py"])], axis=-1) if k else np.zeros((len(part), 0, 2))
                own, others = part["nugget"].to_numpy(float), np.stack(part["pn"]) if k else np.zeros((len(part), 0))
                for j, theta in enumerate(thetas, 1):
                    h, r2 = solve(at, theirs, theta, family, nuggets[j - 1] + own, nuggets[j - 1] + others)
                    if not (r2 > 0).all():
                        raise ValueError("a conditional variance is not positive: places too close for this theta")
                    yield pd.DataFrame({"outcome": np.full(len(part), j), "node": part["node"].to_numpy(), "sqrt_r": np.sqrt(r2), "parents": list(part["parents"]), "h": list(h)})

    return families(points, edges).mapInPandas(run, "outcome int, node bigint, sqrt_r double, parents array<bigint>, h array<double>")


def grid_factors(points: DataFrame, dag: DataFrame, thetas: Sequence[Theta], family: int = MATERN, nugget: float | Sequence[float] = 0.0) -> DataFrame:
    """factors() of a grid: a factor is made for one node of each pattern of offsets dx, dy, and given to all.

    Patterns number about (2 m)^2 at most, whatever the number of nodes: they differ near the borders only. Nuggets by place are not shared, and refused.
    """
    if "nugget" in points.columns:
        raise ValueError("places with nuggets of their own share no factors")
    parents = F.transform(F.array_sort(F.collect_list(F.struct("k", "parent"))), lambda p: p["parent"])
    of_node = points.select(F.col("loc_id").alias("node")).join(neighbors.node_patterns(dag), "node", "left").join(dag.groupBy("node").agg(parents.alias("parents")), "node", "left")
    of_node = storage.once(of_node.select("node", F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents")), "patterns")
    first = of_node.groupBy("pattern").agg(F.min("node").alias("node"))
    needed = dag.select("node", "parent", "k").join(F.broadcast(first.select("node")), "node")
    used = first.select(F.col("node").alias("loc_id")).unionByName(needed.select(F.col("parent").alias("loc_id"))).distinct()
    made = factors(points.join(F.broadcast(used), "loc_id", "left_semi"), needed, thetas, family, nugget)
    made = made.join(first, "node").select("outcome", "pattern", "sqrt_r", "h")
    return of_node.join(F.broadcast(made), "pattern").select("outcome", "node", "sqrt_r", "parents", "h")  # a row for each pattern and outcome


def entries(factors_: DataFrame) -> DataFrame:
    """H as entries: outcome, i, j, v."""
    row = F.concat(
        F.array(F.struct(F.col("node").alias("j"), (1 / F.col("sqrt_r")).alias("v"))),
        F.transform(F.arrays_zip("parents", "h"), lambda p: F.struct(p["parents"].alias("j"), (-p["h"] / F.col("sqrt_r")).alias("v"))),
    )
    return factors_.select("outcome", F.col("node").alias("i"), F.explode(row).alias("e")).select("outcome", "i", "e.j", "e.v")


def log_determinant(factors_: DataFrame) -> DataFrame:
    """Of the precision H'H: outcome, logdet."""
    return factors_.groupBy("outcome").agg((-2 * F.sum(F.ln("sqrt_r"))).alias("logdet"))


def times(h: DataFrame, a: DataFrame) -> DataFrame:
    """H a for entries and a (outcome, loc_id, a): outcome, loc_id, v."""
    b = a.select("outcome", F.col("loc_id").alias("j"), "a")
    return h.join(b, ["outcome", "j"]).groupBy("outcome", F.col("i").alias("loc_id")).agg(F.sum(F.col("v") * F.col("a")).alias("v"))


def transposed_times(h: DataFrame, a: DataFrame) -> DataFrame:
    """H' a."""
    b = a.select("outcome", F.col("loc_id").alias("i"), "a")
    return h.join(b, ["outcome", "i"]).groupBy("outcome", F.col("j").alias("loc_id")).agg(F.sum(F.col("v") * F.col("a")).alias("v"))


def column_norms(h: DataFrame) -> DataFrame:
    """The diagonal of H'H: outcome, loc_id, v."""
    return h.groupBy("outcome", F.col("j").alias("loc_id")).agg(F.sum(F.col("v") * F.col("v")).alias("v"))


def precision(h: DataFrame) -> DataFrame:
    """H'H by nodes that meet in a row of H: outcome, i, j, v. A row has m + 1 entries at most."""
    a = h.select("outcome", F.col("i").alias("row"), F.col("j").alias("i"), F.col("v").alias("a"))
    b = h.select("outcome", F.col("i").alias("row"), "j", F.col("v").alias("b"))
    return a.join(b, ["outcome", "row"]).groupBy("outcome", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def cross_products(h: DataFrame) -> DataFrame:
    """Products of columns of the outcomes' factors, as blankets use them: r, s, i, j, v for outcomes r <= s."""
    a = h.select(F.col("outcome").alias("r"), F.col("i").alias("row"), F.col("j").alias("i"), F.col("v").alias("a"))
    b = h.select(F.col("outcome").alias("s"), F.col("i").alias("row"), "j", F.col("v").alias("b"))
    return a.join(b, "row").filter("r <= s").groupBy("r", "s", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def log_density(factors_: DataFrame, a: DataFrame) -> DataFrame:
    """Half of log determinant less squared norm of H a, by outcome, without the constant: outcome, logdens."""
    squares = times(entries(factors_), a).groupBy("outcome").agg(F.sum(F.col("v") * F.col("v")).alias("ss"))
    return log_determinant(factors_).join(squares, "outcome").select("outcome", (0.5 * (F.col("logdet") - F.col("ss"))).alias("logdens"))


class Levels:
    """Rows of H in levels: a row's parents are all in earlier levels. Solves go level by level."""

    def __init__(self, parents: Sequence[np.ndarray]):
        """parents: positions, each smaller than the row's own."""
        depth = np.zeros(len(parents), np.int64)
        for i, p in enumerate(parents):
            if len(p):
                depth[i] = depth[p].max() + 1
        width = max((len(p) for p in parents), default=0)
        self.index = np.zeros((len(parents), width), np.int64)
        for i, p in enumerate(parents):
            self.index[i, : len(p)] = p
        self._split(depth)

    @classmethod
    def of(cls, index: np.ndarray, depth: np.ndarray) -> Levels:
        """From positions of parents, padded, and the rows' depths."""
        self = cls.__new__(cls)
        self.index = index
        self._split(depth)
        return self

    def _split(self, depth: np.ndarray) -> None:
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []

    def padded(self, h: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros(self.index.shape)
        for i, x in enumerate(h):
            out[i, : len(x)] = x
        return out

    def solve(self, sqrt_r: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        """H^-1 v: x_i = r_i v_i + h_i' x at the parents."""
        x = np.zeros_like(v, dtype=float)
        for rows in self.levels:
            x[rows] = sqrt_r[rows, None] * v[rows] + np.einsum("nk,nkc->nc", h[rows], x[self.index[rows]])
        return x

    def transposed_solve(self, sqrt_r: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        """H'^-1 v, from the last level to the first."""
        w, out = np.array(v, float), np.zeros_like(v, dtype=float)
        for rows in reversed(self.levels):
            out[rows] = sqrt_r[rows, None] * w[rows]
            # H'x = v: what a row gives to its parents is taken over to the other side.
            np.add.at(w, self.index[rows], h[rows][:, :, None] * (out[rows] / sqrt_r[rows, None])[:, None, :])
        return out


#: Rows of H that a task of a solve takes, about.
SOLVE_ROWS = 20_000


class Rows:
    """A task's rows of one outcome's H, for a solve in which all tasks take part: values of other tasks' nodes come as they are found."""

    def __init__(self, nodes: np.ndarray, sqrt_r: np.ndarray, parents: list, h: list, a: np.ndarray):
        order = np.argsort(nodes, kind="stable")
        self.nodes, self.sqrt_r, self.a = nodes[order], sqrt_r[order], a[order].astype(float)
        sizes = np.array([len(parents[i]) for i in order], np.int64)
        ids = np.concatenate([np.asarray(parents[i], np.int64) for i in order]) if len(order) else np.zeros(0, np.int64)
        self.h = np.concatenate([np.asarray(h[i], float) for i in order]) if len(order) else np.zeros(0)
        self.row = np.repeat(np.arange(len(order)), sizes)
        # Entries by parent: which rows wait for it.
        self.asked, which = np.unique(ids, return_inverse=True)
        self.by_parent = np.argsort(which, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.asked)))])

    def entries_of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose parents are among the nodes found, and where in found each one's parent is."""
        at = np.searchsorted(self.asked, found)
        have = np.flatnonzero((at < len(self.asked)) & (np.append(self.asked, -1)[np.minimum(at, len(self.asked))] == found))
        at = at[have]
        counts = self.starts[at + 1] - self.starts[at]
        entry = np.arange(counts.sum()) + np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts)
        return self.by_parent[entry], np.repeat(have, counts)


def told(talk: Talk, nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Nodes and values of the other tasks; and whether no task had any."""
    every = [(np.frombuffer(m[: len(m) // 2], np.int64), np.frombuffer(m[len(m) // 2 :])) for m in talk.everyone(nodes.astype(np.int64).tobytes() + values.tobytes())]
    others = [x for i, x in enumerate(every) if i != talk.tile]
    none = not any(len(n) for n, _ in every)
    return np.concatenate([n for n, _ in others] or [np.zeros(0, np.int64)]), np.concatenate([v for _, v in others] or [np.zeros(0)]), none


def solve_rows(talk: Talk, rows: Rows) -> np.ndarray:
    """H^-1 a for a task's rows: x_i = r_i a_i + h_i' x at the parents, as soon as these are known. A task goes as far as it can, then tells."""
    x, waits = rows.sqrt_r * rows.a, np.bincount(rows.row, minlength=len(rows.nodes))
    fresh = np.flatnonzero(waits == 0)
    sent_n, sent_v = [], []
    while True:
        while len(fresh):
            sent_n.append(rows.nodes[fresh])
            sent_v.append(x[fresh])
            fresh = arrive(rows, x, waits, rows.nodes[fresh], x[fresh])
        nodes, values, none = told(talk, np.concatenate(sent_n or [np.zeros(0, np.int64)]), np.concatenate(sent_v or [np.zeros(0)]))
        if none:
            return x
        sent_n, sent_v = [], []
        fresh = arrive(rows, x, waits, nodes, values)


def arrive(rows: Rows, x: np.ndarray, waits: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Adds what parents that have become known give to their rows; returns the rows that wait for none now."""
    entry, at = rows.entries_of(nodes)
    own = rows.row[entry]
    np.add.at(x, own, rows.h[entry] * values[at])
    np.subtract.at(waits, own, 1)
    touched = np.unique(own)
    return touched[waits[touched] == 0]


def solve_columns(talk: Talk, rows: Rows) -> np.ndarray:
    """H'^-1 a for a task's rows: from the last nodes to the first, a node's value being known once all its children's are."""
    n = len(rows.nodes)
    counts = np.diff(rows.starts)
    nodes, number, _ = told(talk, rows.asked, counts.astype(float))
    waits, w, out = np.zeros(n, np.int64), rows.a.copy(), np.zeros(n)
    place = lambda ids: (np.searchsorted(rows.nodes, ids), np.isin(ids, rows.nodes))
    for ids, values in ((rows.asked, counts.astype(float)), (nodes, number)):
        at, mine = place(ids)
        np.add.at(waits, at[mine], values[mine].astype(np.int64))
    by_row = np.concatenate([[0], np.cumsum(np.bincount(rows.row, minlength=n))])
    parent = np.empty(len(rows.row), np.int64)
    parent[rows.by_parent] = np.repeat(rows.asked, counts)
    fresh = np.flatnonzero(waits == 0)
    sent_n, sent_v = [], []

    def give(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        at, mine = place(ids)
        np.add.at(w, at[mine], values[mine])
        np.subtract.at(waits, at[mine], 1)
        touched = np.unique(at[mine])
        return touched[waits[touched] == 0]

    while True:
        while len(fresh):
            out[fresh] = rows.sqrt_r[fresh] * w[fresh]
            sizes = by_row[fresh + 1] - by_row[fresh]
            entry = np.arange(sizes.sum()) + np.repeat(by_row[fresh] - (np.cumsum(sizes) - sizes), sizes)
            value = rows.h[entry] * np.repeat(out[fresh] / rows.sqrt_r[fresh], sizes)
            mine = np.isin(parent[entry], rows.nodes)
            sent_n.append(parent[entry][~mine])
            sent_v.append(value[~mine])
            fresh = give(parent[entry][mine], value[mine])
        nodes, values, none = told(talk, np.concatenate(sent_n or [np.zeros(0, np.int64)]), np.concatenate(sent_v or [np.zeros(0)]))
        if none:
            return out
        sent_n, sent_v = [], []
        fresh = give(nodes, values)


def inverse_times(factors_: DataFrame, a: DataFrame, transposed: bool = False, tasks: int | None = None) -> DataFrame:
    """H^-1 a, or H'^-1 a, of an outcome and all its nodes: outcome, loc_id, v.

    Rows are dealt to tasks that run at once. A node is solved for when what it needs is known: its parents or, transposed, its children. Tasks
    go as far as they can and then tell each other what they have found, so there are as many messages as the graph is deep, not as it has nodes.
    """
    rows = factors_.join(a.select("outcome", F.col("loc_id").alias("node"), "a"), ["outcome", "node"])
    rows = storage.once(rows.select(F.col("outcome").cast("int").alias("outcome"), F.col("node").cast("bigint").alias("node"), "sqrt_r", "parents", "h", "a"), "solve")
    parts = tasks or max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SOLVE_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk = Talk(TaskContext.get().partitionId())
        frame = pa.Table.from_batches(batches, pa.schema([("outcome", pa.int32()), ("node", pa.int64()), ("sqrt_r", pa.float64()), ("parents", pa.list_(pa.int64())), ("h", pa.list_(pa.float64())), ("a", pa.float64())])).to_pandas()
        outcomes = sorted({int(x) for m in talk.everyone(np.unique(frame["outcome"]).astype(np.int64).tobytes()) for x in np.frombuffer(m, np.int64)})
        for outcome in outcomes:
            part = frame[frame["outcome"] == outcome]
            own = Rows(part["node"].to_numpy(np.int64), part["sqrt_r"].to_numpy(float), list(part["parents"]), list(part["h"]), part["a"].to_numpy(float))
            x = (solve_columns if transposed else solve_rows)(talk, own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), outcome, np.int32)), pa.array(own.nodes), pa.array(x)], ["outcome", "loc_id", "v"])

    return rows.repartition(parts, "node").mapInArrow(run, "outcome int, loc_id bigint, v double", barrier=True)


class Approximation(NamedTuple):
    """What one call builds of a set of places: edges, factors, H by entries, its precision H'H, log determinants, Markov blankets."""

    edges: DataFrame
    factors: DataFrame
    h: DataFrame
    precision: DataFrame
    log_determinant: DataFrame
    blankets: DataFrame


def build(points: DataFrame, thetas: Sequence[Theta], m: int = 15, family: int = MATERN, order: str = "maxmin", nugget: float | Sequence[float] = 0.0) -> Approximation:
    """The sparse approximation of places (loc_id, x, y) for each outcome's theta. Tables are plans until they are used.

    order: as of neighbors.vecchia_dag(); on a grid nodes share factors.
    """
    edges = storage.once(neighbors.vecchia_dag(points, m, order), "edges")
    own = (grid_factors if order == "grid" else factors)(points, edges, thetas, family, nugget)
    h = entries(own)
    return Approximation(edges, own, h, precision(h), log_determinant(own), neighbors.blanket(edges))

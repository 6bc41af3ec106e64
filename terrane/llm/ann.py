"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample: random directions, cut at the median of the sample's rows, down to LEAF of them.
A component is added to each vector that brings all to one length, so that the largest inner product is the smallest
angle. Every row goes to its leaf in each tree. A query walks all trees through one priority queue, ordered by how far
it would have to move to reach a node's side, and visits leaves until they hold SHARE of the sample's
rows, whatever the number of rows. The candidates in the visited leaves are then ranked by their exact
inner products.

Leaves with many rows are dealt in blocks. Of a bounded part of the sample, KNOWN rows, those in a query's visited leaves
tell it a score that K of its candidates reach; leaf candidates below it are left in the task that found them. So they
shorten the lists and add or lose nothing: all candidates come from visited leaves. A row is in a leaf of each tree, and
carries their numbers; a query carries which leaves it visits, so each pair is named once. Trees and sample are
broadcast; SAMPLE bounds them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable, table
from .vectors import BLOCK, best, by_width, in_slices, matrix, valid

TREES, LEAF, SAMPLE, KNOWN, SEED = 8, 64, 16_384, 8_192, 9
#: Share of the rows that a query looks at. In high dimensions without clusters much is needed.
SHARE = 0.8
K, EVERY = 20, 20


class Tree(NamedTuple):
    """Nodes by number: a direction's row, cut, children (below, above), or the leaf's number where below is -1."""

    directions: np.ndarray
    cuts: np.ndarray
    below: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    rows: list[np.ndarray]


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    directions, cuts, below, above, number, rows = [], [], [], [], [], []
    todo = [(np.arange(len(x)), -1, False)]
    while todo:
        ids, parent, upper = todo.pop()
        me = len(cuts)
        if parent >= 0:
            (above if upper else below)[parent] = me
        w = rng.standard_normal(x.shape[1])
        side = x[ids] @ w
        cut = float(np.median(side)) if len(ids) else 0.0
        split = len(ids) > leaf and (side < cut).any()
        directions.append(w)
        cuts.append(cut)
        below.append(-1)
        above.append(-1)
        number.append(-1 if split else len(rows))
        if split:
            todo += [(ids[side < cut], me, False), (ids[side >= cut], me, True)]
        else:
            rows.append(ids)
    return Tree(np.array(directions), np.array(cuts), np.array(below), np.array(above), np.array(number), rows)


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    live = np.flatnonzero(tree.leaf[at] < 0)
    while len(live):
        node = at[live]
        up = np.einsum("ij,ij->i", x[live], tree.directions[node]) >= tree.cuts[node]
        at[live] = np.where(up, tree.above[node], tree.below[node])
        live = live[tree.leaf[at[live]] < 0]
    return tree.leaf[at]


def walk(forest: list[Tree], margins: list[np.ndarray], rows: int, enough: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Leaves (tree, leaf) in the order of the shared queue, until they hold `enough` of the sample's rows; which of these they hold."""
    queue = [(0.0, t, 0) for t in range(len(forest))]
    seen, held, out = np.zeros(rows, bool), 0, []
    while queue and held < enough:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        if (leaf := tree.leaf[node]) >= 0:
            out.append((t, int(leaf)))
            own = tree.rows[leaf]
            held += int((~seen[own]).sum())
            seen[own] = True
            continue
        m = margins[t][node]
        near, other = (tree.above[node], tree.below[node]) if m >= 0 else (tree.below[node], tree.above[node])
        heapq.heappush(queue, (far, t, int(near)))
        heapq.heappush(queue, (far + m * m, t, int(other)))
    return out, seen


def one_length(x: np.ndarray, unit: float, longest: float) -> np.ndarray:
    """Rows scaled by unit, with a component that brings them to the length `longest`."""
    y = x / unit
    return np.column_stack([y, np.sqrt(np.maximum(longest**2 - (y**2).sum(1), 0))])


def top(queries: np.ndarray, own: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of query number and row number with a product of at least `least`, the k best of each query and rows that tie with them."""
    scores = queries @ x.T
    scores[own[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 1e-9 * np.abs(least))
    q, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    exact = np.array([float(np.dot(queries[i], x[j])) for i, j in zip(q, c, strict=True)])
    return q, c, exact


def search(vectors: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE, trees: int = TREES, sample_rows: int = SAMPLE) -> DataFrame:
    """The k nearest found for each query of vectors (vec_id, embedding): query_id, rank, vec_id, score.

    Queries: rows whose vec_id is divisible by `every`; candidates: every row but those with the query's id. score: the inner
    product in double precision. Ties go to the smaller vec_id. Rows with one id each take part, as candidates and as queries. Vectors
    null, empty, zero, or with null or non-finite components take no part. Vectors of each length are searched by themselves. Fewer
    candidates than k: all of them. No rows, or no queries: no rows. Other columns are ignored.
    """
    whole = valid(vectors).filter(F.exists("v", lambda x: x != 0))
    return by_width(whole, lambda part: nearest(part, k, every, share, trees, sample_rows))


def nearest(whole: DataFrame, k: int, every: int, share: float, trees: int, sample_rows: int) -> DataFrame:
    """The search among vectors (vec_id, v) of one length."""
    spark = whole.sparkSession
    whole = durable(whole.withColumn("row", F.monotonically_increasing_id()).select("vec_id", "v", "row"))
    unit = whole.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    out = "query_id bigint, q_row bigint, vec_id bigint, row bigint, score double"
    if unit is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit)))
    longest = whole.agg(F.max(norm)).first()[0]
    picked = whole.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample_rows).collect()  # SAMPLE rows at most
    known = np.array([r["v"] for r in picked])
    known_ids = np.array([r["vec_id"] for r in picked])
    rng = np.random.default_rng(SEED)
    even = one_length(known, unit, longest)
    forest = [grow(even, LEAF, rng) for _ in range(trees)]
    # The rows of a leaf as every row is placed, in case rounding at a cut differs from what it was in growing.
    forest = [t._replace(rows=[np.flatnonzero(own == i) for i in range(len(t.rows))]) for t in forest for own in [leaves(t, even)]]
    some = np.arange(min(KNOWN, len(known)))
    shared = spark.sparkContext.broadcast((forest, unit, longest))
    most = max(len(t.rows) for t in forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest_, unit_, longest_ = shared.value
        for b in in_slices(batches, 1024):
            y = one_length(matrix(b.column(1)), unit_, longest_)
            own = np.column_stack([leaves(tree, y) for tree in forest_]).astype("<i4")
            every = pa.array([x.tobytes() for x in own], pa.binary())
            for t in range(len(forest_)):
                yield pa.RecordBatch.from_arrays([*b.columns, every, pa.array(np.full(len(y), t, np.int32)), pa.array(own[:, t].astype(np.int32))], ["vec_id", "v", "row", "leaves", "tree", "leaf"])

    placed = whole.mapInArrow(place, "vec_id bigint, v array<double>, row bigint, leaves binary, tree int, leaf int")
    sizes = {(r["tree"], r["leaf"]): r["n"] for r in placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()}  # leaves of a bounded sample
    parts = {key: -(-n // BLOCK) for key, n in sizes.items()}
    enough = int(np.ceil(len(known) * min(1.0, share)))
    told = spark.sparkContext.broadcast((parts, known[some], known_ids[some], some, enough, len(known)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest_, unit_, longest_ = shared.value
        parts_, some_, some_ids, at, enough_, rows = told.value
        for b in in_slices(batches, 128):
            q, ids = matrix(b.column(1)), b.column(0).to_numpy()
            flat = np.column_stack([q / unit_, np.zeros(len(q))])
            margins = [flat @ t.directions.T - t.cuts for t in forest_]
            scores = q @ some_.T
            scores[ids[:, None] == some_ids[None, :]] = -np.inf
            to, tree, leaf, part = [], [], [], []
            maps = np.zeros((len(q), len(forest_), most), bool)
            for i in range(len(q)):
                visited, seen = walk(forest_, [m[i] for m in margins], rows, enough_)
                scores[i, ~seen[at]] = -np.inf
                for t, f in visited:
                    maps[i, t, f] = True
                    for p in range(parts_.get((t, f), 0)):
                        to.append(i)
                        tree.append(t)
                        leaf.append(f)
                        part.append(p)
            edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            slack = 1e-9 * np.abs(edge) + 1e-12 * np.sqrt((q**2).sum(1) * (some_**2).sum(1).max())  # products rounded in another order
            edge = np.where(np.isfinite(edge), edge - slack, -np.inf)
            pick = pa.array(to, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pick) for c in b.columns), pa.array([np.packbits(x).tobytes() for x in maps], pa.binary()).take(pick), pa.array(edge).take(pick), *(pa.array(x, pa.int32()) for x in (tree, leaf, part))],
                ["query_id", "q", "q_row", "visited", "edge", "tree", "leaf", "part"],
            )

    queries = whole.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("row").alias("q_row"))
    sent = queries.mapInArrow(route, "query_id bigint, q array<double>, q_row bigint, visited binary, edge double, tree int, leaf int, part int")
    data = placed.withColumn("part", F.lit(0))
    if split := [(t, f, n) for (t, f), n in parts.items() if n > 1]:  # leaves of a bounded sample
        large = F.broadcast(spark.createDataFrame(split, "tree int, leaf int, parts int"))
        data = placed.join(large, ["tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0)]]
        if left.num_rows and right.num_rows:
            x, ids, rows = matrix(right["v"].combine_chunks()), right["vec_id"].to_numpy(), right["row"].to_numpy()
            q, edge, own, q_row = matrix(left["q"].combine_chunks()), left["edge"].to_numpy(), left["query_id"].to_numpy(), left["q_row"].to_numpy()
            first, told_ = key[0].as_py(), left["visited"].combine_chunks()
            in_leaves = np.frombuffer(b"".join(right["leaves"].to_pylist()), "<i4").reshape(len(x), trees)
            for at in range(0, len(q), 512):
                i, j, s = top(q[at : at + 512], own[at : at + 512], edge[at : at + 512], x, ids, k)
                # A row is named in the first tree in which the query visits its leaf, and in no other.
                visited = np.frombuffer(b"".join(told_.slice(at, 512).to_pylist()), np.uint8).reshape(len(q[at : at + 512]), -1)
                visited = np.unpackbits(visited, axis=1)[:, : trees * most].reshape(-1, trees, most)
                fresh = ~visited[i[:, None], np.arange(first)[None, :], in_leaves[j, :first]].any(1)
                i, j, s = i[fresh], j[fresh], s[fresh]
                for to, value in zip(found, (own[at : at + 512][i], q_row[at : at + 512][i], ids[j], rows[j], s), strict=True):
                    to.append(value)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(np.concatenate(c).astype(t)) for n, c, t in zip(("query_id", "q_row", "vec_id", "row", "score"), found, kinds, strict=True)})

    keys = ["tree", "leaf", "part"]
    found = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, out)
    return best(found, F.col("score"), k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_ann": op9_ann}
ORACLES: dict[str, str] = {}

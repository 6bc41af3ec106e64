"""Exact top-k search by a Voronoi kNN join, for integer inner products.

Pivots, a bounded sample, cut the vectors into cells; a vector is in the cell of its nearest pivot. A cell's summary
is its count, its radius and the smallest distances to its pivot, K and as many as rows share a query's id. For a query q and a
cell with pivot p, q.x lies within |q| * |x - p| of q.p. So the summaries give each query a score that K candidates reach for
sure, the rows with its own id not being relied on, and an upper bound for each cell; the query goes to the cells whose bound reaches that score, and to no others.
Cells are dealt in blocks, so that a cell with a third of all vectors is searched by many tasks; a
block finds the K best of each query sent to it, and those are merged. Vectors are moved once, into their
blocks; the queries, a small part of the rows, are what is replicated. Summaries hold PIVOTS rows and are broadcast.

Products are those of doubles where all sums stay below 2 ** 53, and of Python's integers otherwise; scores beyond 64 bits are
held at the ends of their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import durable, table
from .vectors import BLOCK, best, by_width, in_slices, matrix, sample, valid

PIVOTS, SEED = 128, 8
K, SCALE, EVERY = 10, 1024, 100
#: Rows of one query's id for which each cell's summary has distances to spare. Of more, all cells' distances together may do; else the query goes to all cells.
ALIKE = 64


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers held as doubles."""
    if q.size == 0 or x.size == 0:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.zeros((len(q), len(x)), object)
    ints = [np.array([[int(a) for a in r] for r in m], object) for m in (q, x)]
    for d in range(q.shape[1]):  # integers of any length, a component of all pairs at a time
        whole += ints[0][:, d, None] * ints[1][None, :, d]
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def topk(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best rows of x but its own: numbers of queries, ids, scores."""
    scores = products(queries, x)
    qs, vs, ss = [], [], []
    for i in range(len(queries)):
        may = np.flatnonzero(ids != own[i])
        s = scores[i][may]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            may, s = may[s >= edge], s[s >= edge]
        order = np.lexsort((ids[may], -s))[:k]
        qs.append(np.full(len(order), i))
        vs.append(ids[may][order])
        ss.append(s[order])
    return np.concatenate(qs), np.concatenate(vs), np.concatenate(ss)


def search(vectors: DataFrame, k: int = K, scale: float = SCALE, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """The k rows with the highest integer inner product for each query of vectors (vec_id, embedding).

    Components x count as floor(scale * x). Queries: rows whose vec_id is divisible by `every`; candidates: every row but
    those with the query's id. Columns: query_id, rank, vec_id, score. Ties go to the smaller vec_id. Rows with one id
    each take part, as candidates and as queries: a query's id that is repeated has a list for each of its rows. Vectors null, empty, or with null or non-finite components take no part. Vectors of each length are searched by themselves.
    Fewer candidates than k: all of them. No rows, or no queries: no rows. Other columns are ignored.
    """
    whole = valid(vectors).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return by_width(whole, lambda part: nearest(part, k, every, pivots, block))


def nearest(whole: DataFrame, k: int, every: int, pivots: int, block: int) -> DataFrame:
    """The search among vectors (vec_id, v) of one length."""
    whole = durable(whole.withColumn("row", F.monotonically_increasing_id()))
    centers = sample(whole, pivots, SEED)
    spark = whole.sparkSession
    if not len(centers):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    lengths = (centers**2).sum(1)
    shared = spark.sparkContext.broadcast((centers, lengths))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, p2 = shared.value
        for b in in_slices(batches, 2048):
            x = matrix(b.column(1))
            d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + p2, 0)
            near = d.argmin(1)
            away = np.linalg.norm(x - p[near], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32)), pa.array(away)], ["vec_id", "v", "row", "cell", "away"])

    cells = durable(whole.select("vec_id", "v", "row").mapInArrow(cell, "vec_id bigint, v array<double>, row bigint, cell int, away double"))
    mine = cells.filter(F.col("vec_id") % every == 0)
    alike = mine.groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("alike"))
    spare = k + min(ALIKE, alike.agg(F.max("alike")).first()[0] or 1)
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    spread = F.pmod(F.xxhash64("row"), F.lit(64))
    near = cells.select("cell", "away", spread.alias("s")).withColumn("nth", F.row_number().over(Window.partitionBy("cell", "s").orderBy("away"))).filter(F.col("nth") <= spare)
    least = near.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("away")), 1, spare).alias("least"))  # 64 * (k + ALIKE) distances a cell at most
    summary = {r["cell"]: r for r in counts.join(least, "cell").collect()}  # PIVOTS rows at most
    names = np.array(sorted(summary))
    n_blocks = np.array([-(-summary[c]["n"] // block) for c in names])
    told = spark.sparkContext.broadcast((centers[names], names, np.array([summary[c]["radius"] for c in names]), [np.array(summary[c]["least"]) for c in names], n_blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, name, radius, least_, blocks = told.value
        for b in in_slices(batches, 256):
            q = matrix(b.column(1))
            size, toward = np.linalg.norm(q, axis=1), q @ p.T
            # All rows with the query's id may be among those counted on, so as many more than k are asked for.
            sure = -np.sort(-np.concatenate([toward[:, [i]] - size[:, None] * least_[i] for i in range(len(name))], axis=1), axis=1)
            nth = k - 1 + b.column(3).to_numpy()
            told_ = nth < sure.shape[1]
            bound = np.where(told_, np.take_along_axis(sure, np.minimum(nth, sure.shape[1] - 1)[:, None], 1)[:, 0], -np.inf)
            slack = np.where(told_, 1e-6 * (1 + np.abs(np.where(told_, bound, 0.0))), 1.0)
            reach = toward + size[:, None] * radius + 1e-6 * (1 + np.abs(toward)) >= (bound - slack)[:, None]
            row, col = np.nonzero(reach)
            row, col = np.repeat(row, blocks[col]), np.repeat(col, blocks[col])
            part = np.concatenate([np.arange(n) for n in blocks[np.nonzero(reach)[1]]]) if len(row) else np.zeros(0, int)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pick) for i in range(3)), pa.array(name[col].astype(np.int32)), pa.array(part.astype(np.int32))], ["query_id", "q", "q_row", "cell", "part"])

    queries = mine.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("row").alias("q_row")).join(alike, "query_id")
    sent = queries.mapInArrow(route, "query_id bigint, q array<double>, q_row bigint, cell int, part int")
    of_cell = F.element_at(F.create_map(*(F.lit(int(x)) for c, n in zip(names, n_blocks, strict=True) for x in (c, n))), F.col("cell"))
    data = cells.select("vec_id", "v", "cell", F.pmod(F.xxhash64("row", F.lit(1)), of_cell).cast("int").alias("part"))

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = [[np.zeros(0, np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            x, ids = matrix(right["v"].combine_chunks()), right["vec_id"].to_numpy()
            q, own, q_row = matrix(left["q"].combine_chunks()), left["query_id"].to_numpy(), left["q_row"].to_numpy()
            for at in range(0, len(q), 256):
                i, v, s = topk(q[at : at + 256], own[at : at + 256], x, ids, k)
                for to, value in zip(found, (own[at : at + 256][i], q_row[at : at + 256][i], v, s), strict=True):
                    to.append(value)
        return pa.table({name: pa.array(np.concatenate(c).astype(np.int64)) for name, c in zip(("query_id", "q_row", "vec_id", "score"), found, strict=True)})

    found = sent.groupBy("cell", "part").cogroup(data.groupBy("cell", "part")).applyInArrow(solve, "query_id bigint, q_row bigint, vec_id bigint, score bigint")
    return best(found, F.col("score"), k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_exact_topk": op8_exact_topk}
ORACLES = {
    "op8_exact_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
}

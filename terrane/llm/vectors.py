"""What the two vector searches share: valid vectors, pivots, blocks of a cell, merging of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a cell that a task holds at most, about.
BLOCK = 4096


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as double of the rows that take part: no null id, vector or component, all finite, some component."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).filter((F.size("v") > 0) & finite)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def by_width(vectors: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The search among the vectors of each length: inner products need one length."""
    widths = [r["d"] for r in vectors.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # one row a length
    return reduce(DataFrame.unionByName, [search(vectors.filter(F.size("v") == d)) for d in widths or [0]])


def sample(vectors: DataFrame, rows: int, seed: int) -> np.ndarray:
    """At most `rows` vectors, the first in a seeded order of their ids."""
    picked = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(rows).collect()
    return np.array([r["v"] for r in picked], np.float64)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def best(found: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best rows of each query row q_row, with rank from 1; ties to the smaller vec_id."""
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(score.desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)

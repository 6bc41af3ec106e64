"""What the operators of this subpackage share: table access, Arrow slices, durable cuts of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that are turned into Python objects at a time; one row may have more bytes.
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20
#: Longest word that tables of known words hold: longer ones (base64 and the like) are rarely seen again.
LONG_WORD = 64
#: Words as the contracts define them: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch between Spark and Python, instead of the 64 MB of the setting; both sides hold some at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES: rows of texts are thousands of times longer than the rows for which its default is made.

    A smaller bound that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where the session names none: one of its own in local mode (tests), an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows and bytes, so that only those are Python objects at a time."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide), np.zeros(batch.num_rows, np.int64)))
        at = done = 0
        while at < batch.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[min(stop, batch.num_rows) - 1])


#: Bits of the filter that screened() broadcasts at most: 8 MB.
FILTER_BITS = 1 << 26


def screened(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be among those of wanted (one column of that name): all that are, and few others while wanted is small.

    A bit for each hash of a key, broadcast, so that nothing of the other rows is shuffled. Join the rows with wanted, as an
    inner join, for the exact answer; a semi-join would be moved ahead of this filter. Null keys are left out.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.filter(F.col(key).isNotNull()).select(F.bitmap_bucket_number(bit).alias("bucket_"), F.bitmap_bit_position(bit).alias("at_"))
    maps = bits.groupBy("bucket_").agg(F.bitmap_construct_agg("at_").alias("map_"))
    marked = rows.filter(F.col(key).isNotNull()).withColumns({"bucket_": F.bitmap_bucket_number(bit), "at_": F.bitmap_bit_position(bit)}).join(F.broadcast(maps), "bucket_")
    inside = F.expr("shiftright(cast(conv(hex(substring(map_, cast(at_ div 8 as int) + 1, 1)), 16, 10) as int), cast(at_ % 8 as int)) & 1 = 1")
    return marked.filter(inside).select(*rows.columns)


def spans_text(spans: str) -> F.Column:
    """SQL expression of an array of struct(at, rank, kind, upto), as kind:start:end by start, then rank."""
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.at, ':', s.upto)), ',')")

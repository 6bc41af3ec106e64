"""Sharding by minimax contiguous partition.

Documents are dealt to a fixed number of atoms by a hash of their text, so equal texts share an atom. The
atoms, in order, are cut into shards: a binary search finds the smallest capacity at which greedy filling
needs no more shards than there are, and the cuts are then placed within that capacity, each as near as
possible to an even share of what is left.

Only the sizes of the atoms reach the driver: ATOMS rows at most, whatever the input. Slots come from
counts of small parts of an atom, so that a text with very many copies is numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import durable, table

ATOMS = 1 << 16
#: Rows that a numbered part of an atom has on average at most, and the most parts of an atom.
PART_ROWS, MOST_PARTS = 256, 1 << 20


def fits(ends: list[int], capacity: int, shards: int, start: int = 0) -> bool:
    """Whether greedy filling puts the atoms from start on into that many shards of that capacity."""
    base = ends[start - 1] if start else 0
    for _ in range(shards):
        start = bisect_right(ends, base + capacity)
        if start == len(ends):
            return True
        base = ends[start - 1] if start else 0
    return False


def cut(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and for each atom its shard.

    Every shard is within the capacity. A size of 0 is allowed; without atoms the capacity is 0.
    """
    ends = list(accumulate(sizes))
    if not ends:
        return 0, []
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if fits(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    out: list[int] = []
    at, base = 0, 0
    for shard in range(shards):
        left = shards - shard - 1
        most = bisect_right(ends, base + low)
        share = base + (ends[-1] - base) / (left + 1)
        stop = bisect_left(ends, share, at) + 1  # the atom that reaches the share is in, or out if that is nearer
        if stop - 1 > at and stop <= len(ends) and ends[stop - 1] - share > share - ends[stop - 2]:
            stop -= 1
        stop = len(ends) if not left else min(stop, most, len(ends))
        while stop < most and not fits(ends, low, left, stop):
            stop += 1
        out += [shard] * (stop - at)
        at, base = stop, ends[stop - 1] if stop else 0
    return low, out


def shard(docs: DataFrame, shards: int = 40, atoms: int = ATOMS) -> DataFrame:
    """Shard and slot of every row of docs (doc_id, text), with sizes near equal.

    Null text: size 16, checksum 0, grouped with empty texts. Repeated rows and null ids: each row gets a
    slot of its own, in any number of tasks. No rows: no rows. Other columns are ignored. Slots number the rows of a shard by
    atom, then by where the rows lie in docs; so they depend on the partitions of docs, shards do not.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),  # not by id or text, which very many rows may share
    )
    rows = durable(rows)
    sums = sorted(map(tuple, rows.groupBy("atom").agg(F.sum("size"), F.count("*")).collect()))  # at most `atoms` rows
    _, dealt = cut([x[1] for x in sums], shards)
    atom_rows = [(a, s, n, max(1, min(MOST_PARTS, -(-n // PART_ROWS)))) for (a, _, n), s in zip(sums, dealt, strict=True)]
    firsts, seen = [], {}
    for _, s, n, _ in atom_rows:
        firsts.append(seen.get(s, 0))
        seen[s] = firsts[-1] + n
    placed = F.broadcast(spark.createDataFrame([(a, s, f, p) for (a, s, _, p), f in zip(atom_rows, firsts, strict=True)], "atom int, shard int, first long, parts int"))
    parted = rows.join(placed, "atom").withColumn("part", F.pmod("spread", "parts"))
    counts = parted.groupBy("atom", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("atom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("atom", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("atom", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = parted.withColumn("nth", F.row_number().over(order) - 1)
    return numbered.join(counts, ["atom", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("ahead") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}

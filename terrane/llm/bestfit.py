"""Best-fit packing of whole documents: partitions first, what they leave over by a tree.

Documents longer than a sequence are cut into whole sequences and a rest; all others stay whole. A task takes windows of
WINDOW pieces and puts them, longest first, each into the sequence with the least room that holds it. Sequences that are full but for
NEAR tokens are done. The others are items themselves: those of FAN neighbouring tasks meet in one
task, which packs them once more by best fit, and so on until all have met. Only ids and lengths of underfull sequences move,
about 30 bytes each, and a task of the tree takes BLOCK of them at most, about: of more, each of several tasks takes
a part by a hash. Where pieces lie is told by one join of what the tree has moved.

No piece is moved with its tokens, and nothing is collected but a count a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import MODEL, encoder
from .shared import durable, slices, small_batches, table
from .tokencount import tokenizer_path

END, LENGTH = 0, 2048
#: Pieces that a task packs at a time.
WINDOW = 1 << 16
#: Room up to which a sequence is done.
NEAR = 16
#: Tasks whose underfull sequences meet in one task of the next level; and so many sequences that a task takes, about.
FAN, BLOCK = 8, 1 << 17


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """For each item its bin, and for each bin its items' sum: longest first, each into the fullest bin that holds it.

    Items of one size go in their order. A bin is opened only where none holds the item, so no two bins could be one.
    """
    bins, used = [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms = 0  # a bit for each room that some bin has
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        if n > length:
            raise ValueError("an item is longer than a bin")
        if at := open_rooms >> n:
            room = n + (at & -at).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            used[bin_] += n
        else:
            room, bin_ = length, len(used)
            used.append(n)
        bins[i] = bin_
        if left := room - n:
            by_room[left].append(bin_)
            open_rooms |= 1 << left
    return bins, used


def offsets(bins: list[int], sizes: list[int], count: int) -> list[int]:
    """Where each item begins in its bin, items of a bin in their order."""
    ends, out = [0] * count, []
    for b, n in zip(bins, sizes, strict=True):
        out.append(ends[b])
        ends[b] += n
    return out


PIECE = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "bin": pa.int64(), "offset": pa.int64(), "used": pa.int64()}


def packed(docs: DataFrame, model: str | None, end: int, length: int, window: int) -> DataFrame:
    """Pieces of all documents, packed by each task for itself: doc_id, piece, start, length, ids_crc32, bin, offset in it, its tokens."""
    small_batches(docs.sparkSession)
    path = model or tokenizer_path(MODEL)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_, last, named = TaskContext.get().partitionId() << 40, np.array([end], "<u4").tobytes(), None
        done: list[tuple] = []  # pieces that are sequences by themselves
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal bin_
            bins, used = best_fit(sizes := [h[3] for h in held], length)
            rows = [(*h, bin_ + b, at, used[b]) for h, b, at in zip(held, bins, offsets(bins, sizes, len(used)), strict=True)]
            bin_ += len(used)
            for row in done:
                rows.append((*row, bin_, 0, row[3]))
                bin_ += 1
            done.clear()
            held.clear()
            for at in range(0, len(rows), 8192):
                doc, *rest = zip(*rows[at : at + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, named), *(pa.array(c, t) for c, t in zip(rest, PIECE.values(), strict=True))], ["doc_id", *PIECE])

        for b in slices(batches):
            named = b.schema.field(0).type
            for doc, ids in zip(b.column(0).to_pylist(), encoder(path).encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += last
                for nth, start in enumerate(range(0, len(ids) // 4, length)):
                    own = ids[4 * start : 4 * (start + length)]
                    (done if len(own) == 4 * length else held).append((doc, nth, start, len(own) // 4, zlib.crc32(own)))
                if len(held) + len(done) >= window:
                    yield from out()
        if held or done:
            yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, " + ", ".join(f"{c} bigint" for c in PIECE if c != "piece"))


def merged(under: DataFrame, length: int, fan: int, block: int, near: int) -> DataFrame | None:
    """Where the tree puts underfull sequences (bin, used): bin, into, shift. A sequence that stays as it is is not named."""
    spark = under.sparkSession
    # items: the sequences of a level; moved: what each first sequence has become.
    items = under.select(F.shiftright("bin", 40).alias("node"), "bin", "used")
    moved: DataFrame | None = None
    counts = [r["node"] for r in items.select("node").distinct().collect()]  # a row a task of the packing
    nodes = max(counts, default=-1) + 1
    while nodes > 1:
        nodes = -(-nodes // fan)
        items = items.withColumn("node", F.floor(F.col("node") / fan))
        sizes = [(r["node"], -(-r["n"] // block)) for r in items.groupBy("node").agg(F.count("*").alias("n")).collect()]  # a row a task
        if not sizes:
            break
        parts = F.broadcast(spark.createDataFrame(sizes, "node bigint, parts bigint"))
        dealt = items.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("bin"), "parts"))

        def fit(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("bin")
            used, ids = t["used"].to_pylist(), t["bin"].to_numpy()
            bins, sums = best_fit(used, length)
            own = np.array(bins)
            # A bin is named after the first of its sequences.
            names = np.full(len(sums), np.iinfo(np.int64).max)
            np.minimum.at(names, own, ids)
            return pa.table({"node": t["node"], "bin": t["bin"], "into": names[own], "shift": pa.array(offsets(bins, used, len(sums)), pa.int64()), "used": np.array(sums, np.int64)[own]})

        told = durable(dealt.groupBy("node", "part").applyInArrow(fit, "node bigint, bin bigint, into bigint, shift bigint, used bigint"))
        step = told.filter("bin <> into").select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("shift").alias("more"))
            chained = moved.join(later, "into", "left").select("bin", F.coalesce("then", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moved = durable(chained.unionByName(step))
        items = told.filter((F.col("bin") == F.col("into")) & (F.col("used") < length - near)).select("node", "bin", "used")
    return moved


def pack(docs: DataFrame, model: str | None = None, end: int = END, length: int = LENGTH, window: int = WINDOW, fan: int = FAN, block: int = BLOCK, near: int = NEAR) -> DataFrame:
    """The pieces of every row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer and `end`. Of more than `length` ids, it is cut into pieces of `length` and a rest; else it is one
    piece. Null and empty texts: one piece with the end token only. Repeated rows and null ids: packed each by itself. No
    rows: none. Other columns are ignored. Pieces of one length are placed in the order in which they came, so which sequence a
    piece is in depends on the partitions of docs. model: path of the tokenizer's file, which each executor must have.
    """
    pieces = durable(packed(docs, model, end, length, window))
    under = pieces.filter((F.col("offset") == 0) & (F.col("used") < length - near)).select("bin", "used")
    moved = merged(under, length, fan, block, near)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), "offset")
    full, rest = pieces.filter(F.col("used") >= length - near), pieces.filter(F.col("used") < length - near)
    rest = rest.join(moved, "bin", "left").select(*out, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return full.select(*out, F.col("bin").alias("sequence_id"), "offset").unionByName(rest)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op13_best_fit": op13_best_fit}
ORACLES: dict[str, str] = {}

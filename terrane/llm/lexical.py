"""Exact ranked lexical search over shards of alike documents.

Documents are reordered by recursive graph bisection: halves are formed in which documents share terms, by swapping those that gain
most, and halved again. The upper levels are fitted on a bounded sample; every document goes down them, at each
level to the side where its terms are cheaper. The documents of a leaf, in blocks, are then bisected among themselves, down to
shards of SHARD documents.

A shard is one row: its documents, and for each term its postings and the largest impact any document has. An item's bound for a shard is
the sum of these by weight. The shards with the highest bounds are scored first and give a score that K documents reach for
sure. Then each task visits its shards in batches, for each item from the highest bound on, and stops at the first whose
bound is below what K documents reach; equal bounds are visited, since a tie may go to a smaller doc_id. Documents
keep their doc_id throughout, and ties are settled by it, whatever the order of documents.

The terms of the items number the terms of the index: of many items, each of several passes takes a part of them, so that what is
broadcast holds TERMS terms, about. Document frequencies, lengths and counts are those of all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import durable, slices, small_batches, stored, table

K = 10
#: The letters and digits of terms, lower-cased, as a table for bytes: what is no part of a term becomes a space. All bytes beyond ASCII are parts of terms.
PARTS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Distinct terms of the items of a pass, about; each item counts with its own.
TERMS = 1 << 16
#: Documents that the upper levels are fitted on, and the terms of each that are looked at there; how many levels; rounds of swaps at most.
SAMPLE, SAMPLE_TERMS, LEVELS, SWAPS = 4096, 512, 5, 8
#: Documents, and postings, of a block that a task bisects, about; documents of a shard at most.
BLOCK, POSTINGS, SHARD = 2048, 1 << 19, 256
#: Shards that are scored first for each item.
SEEDS = 4
#: Shards that a task looks at at a time.
BATCH = 64


def terms(text: str) -> list[bytes]:
    return text.encode().translate(PARTS).split()


def cost(n: float, d: np.ndarray) -> np.ndarray:
    """Bits for the gaps of terms with d postings among n documents."""
    return d * np.log2(n / (d + 1.0))


def bisect(docs: np.ndarray, starts: np.ndarray, ids: np.ndarray, size: int, swaps: int = SWAPS) -> tuple[np.ndarray, np.ndarray]:
    """Halves documents so that those with common terms are together; what they are is said by starts and ids (size terms)."""
    half = len(docs) // 2
    spans = [ids[starts[d] : starts[d + 1]] for d in docs]
    lengths = np.array([len(s) for s in spans])
    flat = np.concatenate(spans) if len(spans) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(docs)), lengths)
    right = np.zeros(len(docs), bool)
    right[half:] = True
    n1, n2 = max(half, 1), max(len(docs) - half, 1)
    for _ in range(swaps):
        d2 = np.bincount(flat[right[owner]], minlength=size).astype(float)
        d1 = np.bincount(flat, minlength=size) - d2
        now = cost(n1, d1) + cost(n2, d2)
        to_right = now - cost(n1, np.maximum(d1 - 1, 0)) - cost(n2, d2 + 1)
        to_left = now - cost(n1, d1 + 1) - cost(n2, np.maximum(d2 - 1, 0))
        gain = np.bincount(owner, np.where(right[owner], to_left[flat], to_right[flat]), minlength=len(docs))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        worth = int((gain[a[:pairs]] + gain[b[:pairs]] > 1e-9).sum())
        if not worth:
            break
        right[a[:worth]], right[b[:worth]] = True, False
    return docs[~right], docs[right]


def reorder(starts: np.ndarray, ids: np.ndarray, size: int, shard: int) -> list[np.ndarray]:
    """Documents in shards of `shard` at most, in the order that recursive bisection gives them."""
    todo, out = [np.arange(len(starts) - 1)], []
    while todo:
        docs = todo.pop()
        if len(docs) <= shard:
            out.append(docs)
            continue
        left, right = bisect(docs, starts, ids, size)
        todo += [right, left]
    return out


class Levels:
    """The upper levels: for each node of a binary tree, by how much each term is cheaper on the right than on the left."""

    def __init__(self, starts: np.ndarray, ids: np.ndarray, size: int, levels: int, shard: int):
        self.levels, self.weights = levels, np.zeros(((1 << levels) - 1, size), np.float32)
        todo = [(0, np.arange(len(starts) - 1))]
        while todo:
            node, docs = todo.pop()
            if node >= len(self.weights) or len(docs) < 2:
                continue
            left, right = bisect(docs, starts, ids, size)
            d1, d2 = (np.bincount(np.concatenate([ids[starts[d] : starts[d + 1]] for d in side]), minlength=size).astype(float) for side in (left, right))
            n1, n2 = len(left), len(right)
            self.weights[node] = (cost(n1, d1 + 1) - cost(n1, d1)) - (cost(n2, d2 + 1) - cost(n2, d2))
            todo += [(2 * node + 1, left), (2 * node + 2, right)]

    def leaf(self, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The leaf of each document."""
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        node = np.zeros(len(starts) - 1, np.int64)
        for _ in range(self.levels):
            gain = np.bincount(owner, self.weights[node[owner], ids], minlength=len(node))
            node = 2 * node + 1 + (gain > 0)
        return node - len(self.weights)


def lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in the flat values, and these."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def items_of(items: DataFrame) -> DataFrame:
    """item_row, item_id and the distinct terms of each row of items (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted(set(terms(t or ""))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], ["item_row", "item_id", "terms"])

    return items.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "text").mapInArrow(run, f"item_row bigint, item_id {kind}, terms array<binary>")


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """row, doc_id, number of terms, and which of the numbered terms how often, of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in slices(batches):
            lengths, starts, ids, tfs = [], [0], [], []
            for t in b.column(2).to_pylist():
                words = terms(t or "")
                lengths.append(len(words))
                for w, n in Counter(words).items():
                    if (at := number.get(w)) is not None:
                        ids.append(at)
                        tfs.append(n)
                starts.append(len(ids))
            starts = np.array(starts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int64()), lists(starts, np.array(ids, np.int32), pa.int32()), lists(starts, np.array(tfs, np.int32), pa.int32())], ["row", "doc_id", "n", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, n bigint, ids array<int>, tfs array<int>")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for b in batches:
            sums += np.bincount(b.column(0).flatten(), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # TERMS rows, about
        out[r["id"]] = r["n"]
    return out


def index(rows: DataFrame, size: int, documents: int, length: int, levels: int, block: int, shard: int) -> DataFrame:
    """Shards of the rows of counted() that hold any of the terms: shard, its documents, terms, largest impacts, and postings."""
    spark = rows.sparkSession
    some = rows.filter(F.size("ids") > 0)
    picked = some.select(F.slice("ids", 1, SAMPLE_TERMS).alias("ids"), F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).collect()  # SAMPLE rows of SAMPLE_TERMS numbers at most
    starts = np.concatenate([[0], np.cumsum([len(r["ids"]) for r in picked])]).astype(np.int64)
    shared = spark.sparkContext.broadcast(Levels(starts, np.array([i for r in picked for i in r["ids"]], np.int64), size, levels, shard))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids = flat(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.leaf(own, ids).astype(np.int32))], [*b.schema.names, "leaf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema) + ", leaf int"
    placed = durable(some.mapInArrow(place, schema))
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids").cast("bigint")).alias("p")).collect()  # 2 ** levels rows
    parts = F.broadcast(spark.createDataFrame([(r["leaf"], max(-(-r["n"] // block), -(-r["p"] // POSTINGS))) for r in sizes], "leaf int, parts int"))
    dealt = placed.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), "parts").cast("int"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build(key: tuple, t: pa.Table) -> pa.Table:
        t, out = t.sort_by("row"), []
        starts, ids = flat(t["ids"].combine_chunks())
        tfs = t["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * t["n"].to_numpy() * documents) // length
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(starts)))
        leaf, part = key[0].as_py(), key[1].as_py()
        for nth, docs in enumerate(reorder(starts, ids, size, shard)):
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            local = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            order = np.argsort(ids[at], kind="stable")
            own, first = np.unique(ids[at][order], return_index=True)
            impacts = impact[at][order]
            one = lambda values, kind_: lists(np.array([0, len(values)]), values, kind_)
            names = t["doc_id"].combine_chunks().take(pa.array(docs))
            built = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32 | leaf << 16 | nth)], pa.int64()),
                    one(own, pa.int32()),
                    one(np.maximum.reduceat(impacts, first), pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), names),
                    one(first, pa.int32()),
                    one(local[order], pa.int32()),
                    one(impacts, pa.int32()),
                ],
                ["shard", "terms", "top", "docs", "first", "local", "impact"],
            )
            out.append(built)
        return pa.Table.from_batches(out)

    schema = f"shard bigint, terms array<int>, top array<int>, docs array<{kind}>, first array<int>, local array<int>, impact array<int>"
    return stored(dealt.groupBy("leaf", "part").applyInArrow(build, schema), "shards")


class Weighted:
    """Items as numbers and weights of their terms."""

    def __init__(self, found: list[np.ndarray], weights: np.ndarray):
        self.ids = [np.array(f, np.int64) for f in found]
        self.weights = [weights[f] for f in self.ids]
        self.flat, self.heavy = np.concatenate([*self.ids, [0]]).astype(np.int64), np.concatenate([*self.weights, [0]]).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum([len(f) for f in self.ids])]).astype(np.int64)
        self.size = len(weights)

    def bounds(self, own: np.ndarray, top: np.ndarray) -> np.ndarray:
        """What any document of a shard scores at most for each item."""
        most = np.zeros(self.size, np.int64)
        most[own] = top
        sums = np.concatenate([[0], np.cumsum(self.heavy * most[self.flat])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def scores(self, item: int, own: np.ndarray, first: np.ndarray, local: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        out = np.zeros(docs, np.int64)
        at = np.searchsorted(own, self.ids[item])
        for i, w, t in zip(at.tolist(), self.weights[item].tolist(), self.ids[item].tolist(), strict=True):
            if i < len(own) and own[i] == t:
                stop = first[i + 1] if i + 1 < len(own) else len(local)
                out[local[first[i] : stop]] += w * impact[first[i] : stop]  # a document has one posting of a term
        return out


class Best:
    """The k best documents of each item so far, by score and then doc_id; nulls are last."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.rows = k, floor.copy(), [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, docs: list) -> None:
        at = np.flatnonzero((scores >= max(1, self.floor[item])))
        if len(at) > self.k:
            edge = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] >= edge]
        if len(at):
            rows = [*self.rows[item], *((-int(scores[i]), docs[i] is None, docs[i] if docs[i] is not None else 0) for i in at)]
            self.rows[item] = sorted(rows)[: self.k]
            if len(self.rows[item]) == self.k:
                self.floor[item] = max(self.floor[item], -self.rows[item][-1][0])


def visit(shards: DataFrame, items: Weighted, floor: np.ndarray, k: int, chosen: set[tuple[int, int]] | None = None) -> DataFrame:
    """The best documents of each task's shards (item, doc_id, score), and how many shards it visited for the item.

    Shards whose bound for an item is below what k documents reach, at first floor, are not visited. chosen: pairs of item and shard that alone are visited.
    """
    shared = shards.sparkSession.sparkContext.broadcast((items, floor, chosen))
    kind = shards.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, floor_, only = shared.value
        best, visits, named = Best(len(items_.ids), k, floor_), np.zeros(len(items_.ids), np.int64), None
        wanted: dict[int, list[int]] = {}
        for i, s in only or ():
            wanted.setdefault(s, []).append(i)
        for batch in batches:
            named = batch.schema.field(3).type.value_type
            for b in (batch.slice(at, BATCH) for at in range(0, batch.num_rows, BATCH)):
                columns = [flat(b.column(c)) for c in (1, 2, 4, 5, 6)]
                rows = [[v[s[r] : s[r + 1]] for s, v in columns] for r in range(b.num_rows)]
                bounds = np.array([items_.bounds(own, top) for own, top, *_ in rows])
                if only is not None:
                    asked = np.zeros(bounds.shape, bool)
                    for r, s in enumerate(b.column(0).to_pylist()):
                        asked[r, wanted.get(s, [])] = True
                    bounds[~asked] = 0
                names: dict[int, list] = {}
                for i in np.flatnonzero((bounds >= np.maximum(best.floor, 1)).any(0)):
                    for r in np.argsort(-bounds[:, i], kind="stable"):
                        if bounds[r, i] < max(1, best.floor[i]):
                            break
                        own, _, first, local, impact = rows[r]
                        if r not in names:
                            names[r] = b.column(3)[int(r)].as_py()
                        best.add(i, items_.scores(i, own, first, local, impact.astype(np.int64), len(names[r])), names[r])
                        visits[i] += 1
        if named is not None:
            out = [(i, None if null else doc, -s, int(visits[i])) for i, rows in enumerate(best.rows) for s, null, doc in rows]
            item, doc, score, n = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, named), pa.array(score, pa.int64()), pa.array(n, pa.int64())], ["item", "doc_id", "score", "visits"])

    return shards.mapInArrow(run, f"item int, doc_id {kind}, score bigint, visits bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def seeds(shards: DataFrame, items: Weighted, count: int) -> set[tuple[int, int]]:
    """The shards with the highest bounds of each item, as pairs."""
    shared = shards.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_ = shared.value
        bound, shard = np.zeros((0, len(items_.ids)), np.int64), np.zeros((0, len(items_.ids)), np.int64)
        for b in batches:
            (starts, own), (_, top) = flat(b.column(1)), flat(b.column(2))
            fresh = np.array([items_.bounds(own[a:z], top[a:z]) for a, z in zip(starts, starts[1:], strict=False)]).reshape(b.num_rows, -1)
            bound = np.concatenate([bound, fresh])
            shard = np.concatenate([shard, np.broadcast_to(b.column(0).to_numpy()[:, None], fresh.shape)])
            order = np.argsort(-bound, axis=0, kind="stable")[:count]
            bound, shard = np.take_along_axis(bound, order, 0), np.take_along_axis(shard, order, 0)
        at, item = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(bound[at, item]), pa.array(shard[at, item])], ["item", "bound", "shard"])

    found = shards.select("shard", "terms", "top").mapInArrow(run, "item int, bound bigint, shard bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard"))
    return {(r["item"], r["shard"]) for r in found.withColumn("nth", rank).filter(F.col("nth") <= count).collect()}  # `count` rows an item


def search(docs: DataFrame, items: DataFrame, k: int = K, terms_: int = TERMS, levels: int = LEVELS, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The k documents of docs (doc_id, text) with the highest scores for each row of items (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A to Z lower-cased. With N documents that have terms, L their number, n
    that of a document and df of the documents with a term, its weight is floor(1000 ln((2 N + 2) / (2 df + 1))), m is 10 +
    90 n N div L, and a score is the sum of weight * (10 ** 9 tf div (1000 tf + 8 m)) over an item's distinct terms. Only scores above 0 count;
    ties go to the smaller doc_id, null ids last.

    Null and empty texts have no terms: such documents are found by no item, such items find none. Repeated rows, of either table, count
    each by themselves. No documents or no items: no rows. Other columns are ignored.
    """
    asked = durable(items_of(items).filter(F.size("terms") > 0))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-total // terms_))
    dealt = asked.withColumn("pass_", F.pmod(F.xxhash64("item_row"), F.lit(passes)))
    return reduce(DataFrame.unionByName, [one_pass(docs, dealt.filter(F.col("pass_") == i), k, levels, block, shard)[0] for i in range(passes)])


def one_pass(docs: DataFrame, asked: DataFrame, k: int, levels: int, block: int, shard: int) -> tuple[DataFrame, dict]:
    """search() for the rows of items_of(), and what it looked at: shards, pairs of item and shard visited."""
    spark = docs.sparkSession
    rows = asked.orderBy("item_row").collect()  # TERMS terms, about
    numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    out = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    if not rows:
        return spark.createDataFrame([], out), {}
    known = stored(counted(docs, numbers), "terms")
    told = known.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    df = frequencies(known, len(numbers))
    if not told["documents"] or not df.any():
        return spark.createDataFrame([], out), {}
    weights = np.array([math.floor(1000 * math.log((2 * told["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    weighted = Weighted([np.array([numbers[bytes(t)] for t in r["terms"]], np.int64) for r in rows], weights)
    shards = index(known, len(numbers), told["documents"], told["length"], levels, block, shard)
    zero = np.zeros(len(rows), np.int64)
    pairs = seeds(shards, weighted, SEEDS)
    names = [(s,) for s in {s for _, s in pairs}]
    few = shards.join(F.broadcast(spark.createDataFrame(names, "shard bigint")), "shard", "left_semi").select(*shards.columns)
    floor = zero.copy()
    for r in ranked(visit(few, weighted, zero, k, pairs), k).filter(F.col("rank") == k).collect():  # a row an item
        floor[r["item"]] = r["score"]
    found = durable(visit(shards, weighted, floor, k))
    ids = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"))
    best = ranked(found, k).join(ids, "item").select("item_id", "rank", "doc_id", "score")
    return best, {"shards": shards, "found": found, "items": len(rows)}


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical": op11_lexical}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op11_lexical": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("text")}, '{TERM}') AS ts FROM documents WHERE text IS NOT NULL),
d2 AS (SELECT * FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d2),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d2) GROUP BY r, t),
i AS MATERIALIZED (SELECT ir, item_id, unnest(list_distinct(regexp_extract_all({LOWER.format("text")}, '{TERM}'))) AS t FROM (SELECT row_number() OVER () AS ir, * FROM benchmark)),
w AS (SELECT t, CAST(floor(1000 * ln((2 * g.n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t) CROSS JOIN g),
m AS (SELECT r, doc_id, 10 + ((90 * len(ts) * g.n_docs) // g.n_terms) AS m FROM d2 CROSS JOIN g),
s AS (SELECT i.ir, i.item_id, p.r, m.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
      FROM i JOIN p USING (t) JOIN w USING (t) JOIN m ON p.r = m.r GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY ir ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {K}
"""
}

"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

1. Each document's set of distinct shingles has REGISTERS of a HyperMinHash sketch: for each bucket, with a hash
   function of its own so that short documents fill all of them, the smallest hash as its number of leading zeros
   and MANTISSA bits behind. Equal sets are one node from here on, numbered anew: an id may have several sets. Bands
   of ROWS registers give keys; there are so many bands that a pair at the threshold shares none once in 2 / MISS cases.
2. A key that several nodes share has a center: of its nodes the one whose keys are shared most, which in a group of
   edited copies is the original. Nodes whose collision-corrected estimate of similarity with the center is not far
   below the threshold are tied to it. The others of a key are compared, by registers, with all of its nodes.
   What is tied together is a cluster; every pair of nodes that may be linked is in one cluster. An estimate is
   too far below once in 2 / MISS cases for a pair at the threshold.
3. Each node is checked against its cluster's hub on full sets: a cluster is dealt to tasks, each of which reads the hub
   first and the others one after the other. Nodes that are linked with it need no comparison
   among each other; the rest are compared with all nodes of the cluster: estimate first, then full sets.
4. Components of the confirmed links, by alternating large-star and small-star steps.

Comparisons run in blocks of BLOCK nodes and BLOCK_SHINGLES shingles: a task has the rest of one block against all
nodes of another, and hands on one link for each two parts that it joins, not all pairs. Nothing grows with the
square of a group but the comparisons of nodes that are close to a hub yet not linked with it. No state of all
documents is on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LONG_WORD, durable, screened, slices, small_batches, table

ROWS, MANTISSA, MISS = 4, 10, 1e-8
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
WORDS = 120_000


def bands(percent: int) -> int:
    """How many bands miss a pair at the threshold with probability MISS / 2 at most."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** ROWS))


@lru_cache(maxsize=None)
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_170)
    return r.integers(0, 1 << 64, n, np.uint64, False) | np.uint64(1), r.integers(0, 1 << 64, n, np.uint64, False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_name(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Sets of 64-bit hashes of shingles; hashes are kept for words seen before that are not long."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > WORDS:
            known.clear()
        long = {}
        for w in set(words).difference(known):
            (known if len(w) <= LONG_WORD else long)[w] = word_hash(w)
        return np.fromiter((long[w] if w in long else known[w] for w in words) if long else map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words than a shingle has is one shingle, none is an empty set."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes(words)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits behind the first one, as 16-bit registers."""
    zeros = np.zeros(least.shape, np.uint64)
    x = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < np.uint64(1) << np.uint64(64 - step)
        zeros[low] += np.uint64(step)
        x[low] <<= np.uint64(step)
    behind = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | behind).astype(np.uint16)


def sketch(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Registers of sets that lie one after the other; none of them is empty."""
    a, b = multipliers(n)
    out = np.empty((len(starts), n), np.uint64)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((flat ^ b[i]) * a[i], starts)
    return compress(out)


def keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    r = registers.reshape(len(registers), -1, ROWS).astype(np.uint64)
    packed = r[:, :, 0] | r[:, :, 1] << np.uint64(16) | r[:, :, 2] << np.uint64(32) | r[:, :, 3] << np.uint64(48)
    return mixed(packed + np.arange(r.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


@lru_cache(maxsize=4096)
def chance(a: int, b: int) -> float:
    """How often a register of two sets without common shingles collides, their sizes being about 2**(a/4) and 2**(b/4)."""
    zeros = np.arange(64)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)

    def cell(n: float) -> np.ndarray:
        return np.exp(n * np.log1p(-np.minimum(low, 1 - 1e-12))) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-12)))

    return float((cell(2 ** (a / 4)) * cell(2 ** (b / 4))).sum())


def estimate(equal: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for chance collisions."""
    la, lb = np.broadcast_arrays(np.round(4 * np.log2(a)).astype(int), np.round(4 * np.log2(b)).astype(int))
    codes, back = np.unique(la * 1000 + lb, return_inverse=True)
    e = np.array([chance(*divmod(int(c), 1000)) for c in codes])[back].reshape(la.shape)
    return (equal / n - e) / (1 - e)


@lru_cache(maxsize=None)
def cutoff(percent: int, n: int) -> float:
    """The least estimate, of n registers, at which a pair may be linked: lower once in 2 / MISS cases at the threshold, by the binomial distribution."""
    t, below = percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * t**k * (1 - t) ** (n - k)
        if below > MISS / 2:
            return (k - 1) / n
    return 1.0


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), set_id and registers of every row; the last two null for an empty set."""
    n = bands(percent) * ROWS
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in slices(batches):
            sets = [shingler.sets(t) for t in b.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            regs: list = [None] * len(sets)
            ids: list = [None] * len(sets)
            if len(full):
                starts = np.cumsum([0, *sizes[full]])[:-1]
                for i, own in zip(full, sketch(np.concatenate([sets[i] for i in full]), starts, n), strict=True):
                    regs[i], ids[i] = own.tobytes(), set_name(sets[i].tobytes())
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_id", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, set_id binary, registers binary")


def stars(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, are stars: no node is the larger end of two, or of one and the smaller of another. Then b is the smallest of a's component."""
    ends = [F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("a", 1), ("b", 0))]
    nodes = edges.select(F.explode(F.array(*ends)).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return nodes.filter("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), each node with the smallest of its component: node, root. Nodes without edges are not in it.

    Each step costs the driver a dozen jobs; so stars, as most ties are from the start, get none.
    """
    e = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = durable(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = durable(small.select("x.a", "x.b").filter("a != b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def blocks(rows: DataFrame, group: str, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Deals rows (group, node, rest, ...) to tasks (group, i, j): all the rest of block i, and all nodes of block j.

    A block has about `block` nodes at most, and about so many shingles if rows have their number as n.
    is_rest: the row stands for the rest of block i; is_all: for the nodes of block j. Groups without rest are left out.
    """
    rest, n = F.col("rest").cast("long"), F.col("n") if "n" in rows.columns else F.lit(0)
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"), F.sum(rest).alias("rests"), F.sum(n).alias("width"), F.sum(n * rest).alias("rest_width")).filter("rests > 0 and size > 1")
    number = lambda count, width: F.ceil(F.greatest(F.col(count) / block, F.col(width) / shingles)).cast("int")
    sizes = sizes.select(F.col(group).alias("of_group"), number("size", "width").alias("nj"), number("rests", "rest_width").alias("ni"))
    dealt = rows.join(sizes, rows[group] == sizes["of_group"]).drop("of_group")
    dealt = dealt.withColumn("own_j", F.pmod(F.xxhash64("node"), "nj")).withColumn("own_i", F.pmod(F.xxhash64("node", F.lit(1)), "ni"))
    i = F.sequence(F.lit(0), F.col("ni") - 1)
    as_all = F.transform(i, lambda x: F.struct(x.cast("long").alias("i"), F.col("own_j").cast("long").alias("j"), (F.col("rest") & (x == F.col("own_i"))).alias("is_rest"), F.lit(True).alias("is_all")))
    j = F.sequence(F.lit(0), F.col("nj") - 1)
    as_rest = F.transform(F.filter(j, lambda x: F.col("rest") & (x != F.col("own_j"))), lambda x: F.struct(F.col("own_i").cast("long").alias("i"), x.cast("long").alias("j"), F.lit(True).alias("is_rest"), F.lit(False).alias("is_all")))
    out = dealt.withColumn("to", F.explode(F.concat(as_all, as_rest)))
    return out.select(*rows.columns, "to.i", "to.j", "to.is_rest", "to.is_all")


class Parts:
    """Which nodes of a task are joined already."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return int(x)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def compare(pdf: pd.DataFrame, percent: int, exact: bool) -> pd.DataFrame:
    """Links of the rest of a task with its nodes, one for each two parts that they join.

    Nodes that are not rest count as joined. exact: links are confirmed on the sets; else the estimate tells.
    """
    pdf = pdf.sort_values(["node", "is_all"]).reset_index(drop=True)
    registers = np.stack([np.frombuffer(x, np.uint16) for x in pdf["registers"]])
    n, width = pdf["n"].to_numpy(), registers.shape[1]
    nodes, rest, of_all = pdf["node"].to_numpy(), pdf["is_rest"].to_numpy(), pdf["is_all"].to_numpy()
    parts, least = Parts(len(pdf)), cutoff(percent, width)
    linked = np.flatnonzero(~pdf["rest"].to_numpy())
    if len(linked):
        parts.up[linked] = linked[0]
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]] if exact else []
    found = []
    for r in np.flatnonzero(rest):
        other = of_all & (100 * np.minimum(n, n[r]) >= percent * np.maximum(n, n[r])) & (parts.roots() != parts.find(r))
        other = np.flatnonzero(other)
        if not len(other):
            continue
        near = estimate((registers[other] == registers[r]).sum(1), width, n[other], n[r])
        order = np.argsort(-near, kind="stable")
        other = other[order][near[order] >= least]
        at = 0
        while at < len(other):
            some, at = other[at : at + 128], at + 128
            some = some[parts.roots()[some] != parts.find(r)]
            if not len(some):
                continue
            if exact:
                flat = np.concatenate([sets[i] for i in some])
                place = np.searchsorted(sets[r], flat)
                place[place == len(sets[r])] = 0
                common = np.add.reduceat((sets[r][place] == flat).astype(np.int64), np.cumsum([0, *n[some]])[:-1])
                some = some[100 * common >= percent * (n[some] + n[r] - common)]
            for i in some:
                if parts.find(i) != parts.find(r):
                    parts.join(int(i), int(r))
                    found.append((nodes[r], nodes[i]))
    return pd.DataFrame(found, columns=["a", "b"])


def near_center(percent: int, n: int) -> Column:
    """Whether the estimate for columns ra, na, rb, nb lets them be linked."""
    least = cutoff(percent, n)

    @F.pandas_udf("boolean")
    def near(ra: pd.Series, na: pd.Series, rb: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (ra, rb))
        return pd.Series(estimate((a == b).sum(1), n, na.to_numpy(), nb.to_numpy()) >= least)

    return near("ra", "na", "rb", "nb")


def clusters(nodes: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) of nodes (node, n, registers): every pair that may be linked is connected by them."""
    width = bands(percent) * ROWS
    kind = nodes.schema["node"].dataType.simpleString()

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            own = keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, width))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), own.shape[1]))), pa.array(own.ravel())], ["node", "key"])

    members = nodes.select("node", "registers").mapInArrow(members_of, f"node {kind}, key bigint")
    counts = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = durable(members.join(counts, "key"))
    known = shared.groupBy("node").agg(F.sum("size").alias("known"))
    ranked = shared.join(known, "node").select("key", "node", "known")
    centers = ranked.groupBy("key").agg(F.max(F.struct("known", "node"))["node"].alias("center"))
    edges = shared.join(centers, "key").select("key", "node", "center").filter("node != center")
    slim = nodes.select("node", "n", "registers")
    pairs = edges.select("node", "center").distinct()
    pairs = pairs.join(slim.select("node", F.col("n").alias("na"), F.col("registers").alias("ra")), "node")
    pairs = pairs.join(slim.select(F.col("node").alias("center"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "center")
    judged = durable(pairs.withColumn("near", near_center(percent, width)).select("node", "center", "near"))
    ties = judged.filter("near").select(F.col("node").alias("a"), F.col("center").alias("b"))
    # Keys with nodes that are far from the center: those nodes against all of the key.
    # Where a key has but two nodes, that was their comparison.
    more = shared.filter("size > 2").join(centers, "key")
    by_key = more.filter("node != center").join(judged, ["node", "center"]).select("key", "node", (~F.col("near")).alias("rest"))
    by_key = by_key.unionByName(more.filter("node = center").select("key", "node", F.lit(False).alias("rest")))
    dealt = blocks(by_key, "key").join(slim, "node")

    def of_task(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pdf, percent, exact=False)

    far = dealt.groupBy("key", "i", "j").applyInPandas(of_task, f"a {kind}, b {kind}")
    return durable(ties.unionByName(far))


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The sets of nodes (doc_id, set_id, ...): set_id, hashes.

    Most texts are no node's that has a likeness; they are screened off ahead of the shuffle.
    """
    ids = nodes.select("doc_id").distinct()
    texts = screened(docs.select("doc_id", "text"), "doc_id", ids).join(ids.withColumnRenamed("doc_id", "of_id").hint("shuffle_hash"), F.col("doc_id") == F.col("of_id")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in slices(batches):
            sets = [s.tobytes() for s in map(shingler.sets, b.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["set_id", "hashes"])

    return texts.mapInArrow(run, "set_id binary, hashes binary")


def with_hubs(tasks: DataFrame, percent: int) -> DataFrame:
    """Rows (cluster, part, is_hub, node, hashes), in each part the hub first: node, hub, linked for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, name = -1, np.zeros(0, np.uint64), None
        for b in slices(batches):
            out: list[tuple[int, int, bool]] = []
            for cluster, part, is_hub, node, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(x, np.uint64)
                if is_hub:
                    hub, own, name = node, s, (cluster, part)
                    continue
                assert name == (cluster, part), "a part without its hub"
                place = np.searchsorted(own, s)
                place[place == len(own)] = 0
                common = int((own[place] == s).sum())
                out.append((node, hub, 100 * common >= percent * (len(s) + len(own) - common)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["node", "hub", "linked"])

    return tasks.select("cluster", "part", "is_hub", "node", "hashes").mapInArrow(run, "node bigint, hub bigint, linked boolean")


def confirmed(cluster: DataFrame, ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), on full sets, that join what is linked within the clusters (node, cluster, n, registers)."""
    # The hub of a cluster: the node that most nodes of the cluster tie to.
    degree = ties.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    slim = cluster.select("node", "cluster", "n")
    about = slim.join(degree, "node").groupBy("cluster").agg(
        F.max(F.struct("degree", "node"))["node"].alias("hub"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    mine = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "parts").cast("int")))
    dealt = slim.join(about, "cluster").select("node", "cluster", (F.col("node") == F.col("hub")).alias("is_hub"), F.explode(mine).alias("part"))
    dealt = dealt.join(sets, "node").repartition("cluster", "part").sortWithinPartitions("cluster", "part", F.desc("is_hub"))
    judged = durable(with_hubs(dealt, percent))
    direct = judged.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rest = judged.filter("not linked").select("node", F.lit(True).alias("rest"))
    slim = slim.join(rest, "node", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
    dealt = blocks(slim, "cluster").join(cluster.select("node", "registers"), "node").join(sets, "node")

    def of_task(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pdf, percent, exact=True)

    return direct.unionByName(dealt.groupBy("cluster", "i", "j").applyInPandas(of_task, "a bigint, b bigint"))


def dedup(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Near-duplicate components of docs (doc_id, text): doc_id, n_shingles, component_id, kept; a row for each row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles of `size` words.
    A component is named by its smallest doc_id, whose row is kept (all of them, if it is repeated).

    Null and empty texts, and texts without words: empty set, linked with nothing. Rows that share a doc_id are one
    document and linked with each other, each by its own text with others. Null doc_id: takes no part; component_id null,
    kept. No rows: none. Other columns are ignored. Ties between centers go to the larger node.
    """
    small_batches(docs.sparkSession)
    rows = durable(signatures(docs, size, percent))
    full = rows.filter("n > 0 and doc_id is not null")
    own = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("registers").alias("registers"))  # a set has one n and registers
    nodes = durable(own.withColumn("node", F.monotonically_increasing_id()))
    ties = clusters(nodes.select("node", "n", "registers"), percent)
    cluster = components(ties).select("node", F.col("root").alias("cluster"))
    cluster = durable(cluster.join(nodes, "node"))
    sets = sets_of(docs, cluster, size).dropDuplicates(["set_id"])
    sets = durable(cluster.select("node", "set_id").join(sets, "set_id").select("node", "hashes"))
    links = confirmed(cluster, ties, sets, percent)
    # Rows of one id with different sets are one document.
    repeated = full.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).filter("x != y").select(F.col("doc_id").alias("id"), "x")
    same = full.join(repeated, full["doc_id"] == repeated["id"]).select("set_id", "x").distinct().filter("set_id != x")
    by_set = nodes.select("set_id", "node")
    same = same.join(by_set.withColumnRenamed("node", "a"), "set_id").join(by_set.select(F.col("set_id").alias("x"), F.col("node").alias("b")), "x").select("a", "b")
    roots = durable(components(links.unionByName(same)))
    linked = nodes.select("node", "set_id", "doc_id").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("least"))
    least = linked.join(least, "root").select(F.col("set_id").alias("s"), "least")
    named = nodes.select("set_id", "doc_id").join(least, F.col("set_id") == F.col("s"), "left").select(F.col("set_id").alias("s"), F.coalesce("least", "doc_id").alias("least"))
    named = durable(named)
    out = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    out = out.join(named, out["set_id"] == named["s"], "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES = {
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
h AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
}

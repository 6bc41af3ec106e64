"""Ranked lexical search, centroid clustering and best-fit packing: by value against plain Python, and over odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import bestfit, clustering, lexical
from terrane.llm.tokencount import tokenizer_path

DOCS = "doc_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranks_of(docs, items, k=10):
    """Plain scores of all documents for all items."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return out


def null_last(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


ODD_DOCS = [
    (1, "The CAT sat. Ünïcode Ünïcode"), (2, None), (3, ""), (4, " ,;- "), (5, "cat " * 3000 + "dog"), (6, "dog cat"), (6, "dog cat"), (7, "dog cat"), (None, "dog cat"), (8, "日本 cat\x00dog x" + "y" * 5000), (9, "Äpfel äpfel ÄPFEL"),
]
ODD_ITEMS = [(1, "cat dog cat"), (1, "cat dog cat"), (2, None), (3, " . "), (None, "ünïcode Ünïcode the"), (4, "äpfel Äpfel"), (5, "nowhere"), (6, "日本 dog")]


@pytest.mark.parametrize("most", [lexical.TERMS, 3])
def test_search_of_odd_rows(spark, most):
    docs = spark.createDataFrame(ODD_DOCS, DOCS).withColumns({c: F.lit("x") for c in ("ids", "n", "row", "leaf", "part", "shard", "score", "terms")})
    items = spark.createDataFrame(ODD_ITEMS, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("terms", "item", "pass_", "rank")})
    assert null_last(lexical.search(docs, items, terms_=most).collect()) == null_last(ranks_of(ODD_DOCS, ODD_ITEMS))


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame(ODD_DOCS, DOCS), spark.createDataFrame(ODD_ITEMS, "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items), (docs, items.filter("item_id = 5"))):
        assert lexical.search(d, i).collect() == []


def topics(rng, n, topics_=8, words=40):
    return [(i, " ".join(f"t{t}w{w}" for w in rng.zipf(1.5, 30) % words for t in [i % topics_])) for i in range(n)]


def test_search_visits_few_shards_of_topics(spark):
    """Documents of eight topics, dealt at random: shards hold one topic each, so an item visits some of them only; results stay exact."""
    rng = np.random.default_rng(3)
    rows = topics(rng, 1600)
    items = [(t, " ".join(f"t{t}w{w}" for w in range(20, 26))) for t in range(8)]
    docs, asked = spark.createDataFrame(rows, DOCS).repartition(4), lexical.items_of(spark.createDataFrame(items, "item_id bigint, text string"))
    best, told = lexical.one_pass(docs, asked, 10, 3, 200, 25)
    assert sorted(map(tuple, best.collect())) == sorted(ranks_of(rows, items))
    shards = told["shards"].count()
    of_topic = [{i // 40 for i in r["terms"]} for r in told["shards"].select("terms").collect()]
    assert shards >= 64 and np.mean([len(t) for t in of_topic]) < 2
    visited = told["found"].groupBy("item").agg(F.sum(F.col("visits") / 10)).collect()
    assert sum(r[1] for r in visited) < 8 * shards / 3


def test_bisection_parts_topics():
    rng = np.random.default_rng(1)
    ids = [rng.choice(50, 12, replace=False) + 50 * (d % 2) for d in range(64)]
    starts = np.arange(65) * 12
    left, right = lexical.bisect(np.arange(64), starts, np.concatenate(ids), 100)
    assert len(left) == len(right) == 32 and set(left % 2) in ({0}, {1}) and set(left % 2) != set(right % 2)
    shards = lexical.reorder(starts, np.concatenate(ids), 100, 10)
    assert sorted(np.concatenate(shards)) == list(range(64)) and max(map(len, shards)) <= 10


def test_one_common_document_is_dealt_to_tasks(spark):
    """A third of the rows alike: their leaf is dealt in blocks, none of which holds more than about its share."""
    rows = [(i, "same words here") for i in range(400)] + topics(np.random.default_rng(4), 800)
    known = lexical.stored(lexical.counted(spark.createDataFrame(rows, DOCS), {t: i for i, t in enumerate(sorted({w.encode() for _, x in rows for w in x.split()}))}), "terms")
    shards = lexical.index(known, 1000, 1200, 30_000, 3, 64, 16)
    blocks = shards.groupBy(F.shiftright("shard", 16)).agg(F.sum(F.size("docs")).alias("n")).collect()
    assert sum(r["n"] for r in blocks) == 1200 and max(r["n"] for r in blocks) <= 128


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, j, d in found:
        sums[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, j, d, sums[j], sum(sums.values()), names[j]) for i, j, d in found]


VECTORS = "vec_id bigint, embedding array<double>"


def cloud(rng, n, spread=0.05):
    centers = rng.normal(size=(9, 64))
    return [(i, [float(x) for x in centers[i % 9] + spread * rng.normal(size=64)]) for i in range(n)]


@pytest.mark.parametrize("case", ["clusters", "ties", "few", "large"])
def test_clusters(spark, case):
    rng = np.random.default_rng(5)
    rows = cloud(rng, 150)
    if case == "ties":  # a small grid, a third of all rows alike, repeated ids
        rows = [(i % 70, [float(rng.integers(0, 2)) / 64 for _ in range(2)] + [0.0] * 62) for i in range(100)] + [(500 + i, [1.0] * 64) for i in range(50)]
        rows += [(None, [0.5] * 64), (None, [0.25] * 64), (7, None), (8, [1.0]), (9, [None] * 64), (10, [float("nan")] * 64), (11, [float("inf")] * 64), (12, [])]
    elif case == "few":
        rows = rows[:5]
    elif case == "large":
        rows = [(i, [x * 60_000 for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("v", "cluster", "upper", "distance", "taken")})
    assert null_last(clustering.cluster(table).collect()) == null_last(plain_clusters(rows))


def test_clusters_without_rows_and_too_large(spark):
    assert clustering.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert clustering.cluster(spark.createDataFrame([(1, None), (2, [1.0])], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64)], VECTORS))


def test_bounds_hold_and_spare_distances():
    """Through moves of centroids: clusters as by all distances, bounds never on the wrong side, few distances where clusters are clear."""
    rng = np.random.default_rng(6)
    x = np.array([[math.floor(64 * c) for c in v] for _, v in cloud(rng, 600)], np.int64)
    c = x[rng.choice(600, 16, replace=False)].copy()
    own = clustering.group(c, 4)
    state = clustering.first(x, c, own)
    for step in range(6):
        moved = c + rng.integers(-6 if step < 3 else -1, 7 if step < 3 else 2, c.shape)
        drift = np.sqrt(((moved - c) ** 2).sum(1))
        c = moved
        *state, taken = clustering.again(x, *state, c, own, drift)
        d = clustering.squared(x, c)
        assert (state[0] == d.argmin(1)).all()
        assert (state[1] * (1 + 1e-9) + 1e-9 >= np.sqrt(d.min(1))).all()
        d = np.where(np.arange(16) == state[0][:, None], np.inf, np.sqrt(d))
        assert all((state[2][:, g] <= d[:, own == g].min(1, initial=np.inf) * (1 + 1e-9) + 1e-9).all() for g in range(own.max() + 1))
    assert taken < 600 * 16 / 4


def pieces_of(docs, length=2048):
    known = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for d, t in docs:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        for nth, at in enumerate(range(0, len(ids), length)):
            own = ids[at : at + length]
            out.append((d, nth, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def check_bins(rows, length):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= length
    return len(bins)


def test_best_fit_is_that_of_a_plain_search():
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(1, 101, 300), rng.choice([34, 33, 51], 200), [100] * 5, [1] * 250, []):
        bins, used = bestfit.best_fit(list(map(int, sizes)), 100)
        plain = []
        for n in sorted(map(int, sizes), reverse=True):
            fits = [r for r in plain if r >= n]
            if fits:
                plain.remove(min(fits))
                plain.append(min(fits) - n)
            else:
                plain.append(100 - n)
        assert sorted(100 - u for u in used) == sorted(plain)
        sums = Counter()
        for b, n in zip(bins, sizes, strict=True):
            sums[b] += int(n)
        assert [sums[b] for b in range(len(used))] == used
    with pytest.raises(ValueError):
        bestfit.best_fit([101], 100)


@pytest.mark.parametrize(("fan", "block", "window"), [(8, 1 << 17, 1 << 16), (2, 5, 7)])
def test_bins_of_odd_rows(spark, fan, block, window):
    rows = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "word " * 5000), (5, "x" * 9000), (6, "twice"), (6, "twice"), (None, "no id"), (7, "日本 😀 ÄÖ")]
    rows += [(100 + i, "word " * (i % 40 * 50)) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("bin", "used", "node", "piece", "start", "into", "part")}).repartition(9)
    got = bestfit.pack(docs, fan=fan, block=block, window=window).collect()
    assert null_last((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == null_last(pieces_of(rows))
    n, sizes = check_bins(got, 2048), [r["length"] for r in got]
    plain = len(bestfit.best_fit(sizes, 2048)[1])
    assert n <= plain * (1.1 if window > 7 else 1.3) + 2  # windows of a few pieces have little to choose from
    assert bestfit.pack(docs.limit(0)).collect() == []


def test_tree_merges_what_tasks_leave_over(spark):
    """A document a task: only the tree brings them together."""
    rows = [(i, "word " * 300) for i in range(40)]
    got = bestfit.pack(spark.createDataFrame(rows, DOCS).repartition(40, "doc_id"), fan=4).collect()
    assert check_bins(got, 2048) == math.ceil(40 / (2048 // 301))


def test_bins_of_many_pieces_are_few(spark):
    """With hundreds of pieces a task, hardly more sequences than one best fit over all pieces has."""
    rng = np.random.default_rng(8)
    rows = [(i, "word " * int(n)) for i, n in enumerate(rng.lognormal(6, 1, 1500))]
    got = bestfit.pack(spark.createDataFrame(rows, DOCS).repartition(4), fan=2).collect()
    assert check_bins(got, 2048) <= len(bestfit.best_fit([r["length"] for r in got], 2048)[1]) * 1.005 + 1

"""Keys that stand in a third of all rows: the largest task stays small, and results stay whole."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import knn, langid, mixing, neardup, secrets, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def hot_rows(n, doc_id):
    """A third of the rows have one id, or none, and one text."""
    secret = 'mail password = "abcdefghijkl0123" and more'
    return [(doc_id if i % 3 == 0 else i, secret if i % 3 == 0 else f"text {i} has words " * (i % 5 + 1), "en", "a" if i % 4 else "b", 0) for i in range(1, n + 1)]


def clustered(rng, copies, k=10):
    """Query 100 in some copies, rows near it, more a little farther, and clusters elsewhere."""
    q = np.zeros(8)
    q[0] = 4.0
    rows = [(100, q.tolist())] * copies
    rows += [(1000 + i, (q + 0.01 * rng.normal(size=8)).tolist()) for i in range(11 - copies if copies < 11 else 0)]
    rows += [(2001 + i, (0.9 * q + 0.02 * rng.normal(size=8)).tolist()) for i in range(20)]
    for c in range(6):
        center = 2 * rng.normal(size=8)
        rows += [(3001 + 97 * c + i, (center + 0.05 * rng.normal(size=8)).tolist()) for i in range(60)]
    return rows


@pytest.mark.parametrize("copies", [1, 2, 3, 5, 9, 12, 20])
def test_topk_of_repeated_queries_is_whole(spark, copies, monkeypatch):
    rows = clustered(np.random.default_rng(copies), copies)
    monkeypatch.setattr(knn, "ALIKE", 4 if copies == 20 else 64)  # more copies than summaries allow for
    got = knn.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), pivots=24).collect()
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            scores = sorted((-int(x[i] @ x[j]), v) for j, (v, _) in enumerate(rows) if v != q)[:10]
            want += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("doc_id", [None, 6])
def test_mix_cuts_a_bin_of_one_id(spark, doc_id, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 64)
    rows = hot_rows(3000, doc_id)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    slim = docs.select("source", F.lit(1).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"), F.substring(F.md5(F.concat(F.lit("mix-1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 3).alias("bin")).persist()
    bins = slim.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("n"))
    _, parts = mixing.cut(slim, bins, bins.groupBy("source").agg(F.sum("n").alias("rows")))
    assert parts.agg(F.max("bin_size")).first()[0] < 150 and parts.agg(F.sum("bin_size")).first()[0] == 3000
    got = mixing.mix(docs).collect()
    sizes = {(r["source"]): r for r in got}
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((d or 0, len(re.findall(r"[^ \t-\r]+", t))) for d, t, *_ in rows)
    for source, r in sizes.items():
        taken = sum(x["whole"] * x["size"] + x["extra"] for x in got if x["source"] == source)
        assert abs(taken - r["target"]) <= 1


@pytest.mark.parametrize("doc_id", [None, 6])
def test_one_row_of_a_common_blob_is_moved(spark, doc_id, monkeypatch):
    monkeypatch.setattr(secrets, "COPIES", 16)
    rows = hot_rows(900, doc_id)
    found, new = secrets.scan(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = found.select("doc_id", F.col("spans.at").alias("at")).collect()
    assert len(got) == 900 and sum(len(r["at"]) > 0 for r in got) == 300
    assert all(bool(r["at"]) == (r["doc_id"] == doc_id) for r in got)
    texts = {t for _, t, *_ in rows}
    blobs = new.groupBy("blob_id").count().collect()
    assert {r["blob_id"] for r in blobs} == {hashlib.sha256(t.encode()).hexdigest() for t in texts} and all(r["count"] == len(secrets.RULES) for r in blobs)
    # A second scan with this ledger finds the same and has nothing new.
    again, none = secrets.scan(spark.createDataFrame(rows, SCHEMA), new)
    assert none.count() == 0 and again.filter(F.size("spans") > 0).count() == 300


@pytest.mark.parametrize("doc_id", [None, 6])
def test_slots_of_rows_alike_are_dealt_to_parts(spark, doc_id):
    got = sharding.shard(spark.createDataFrame(hot_rows(3000, doc_id), SCHEMA).repartition(6), 5).collect()
    assert len(got) == 3000 and len({r["shard"] for r in got if r["doc_id"] == doc_id}) == 1
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_learnt_weights_are_those_of_plain_counts(spark):
    """All grams of the rows, none left out: each one's log probability, leaning to its mean over the languages."""
    rows = [(i, " ".join(f"{lang}wort{(i * j) % 17}" for j in range(20)) + " Ab", lang) for i in range(60) for lang in ("xx", "yy", "zz")]
    rows = [(3 * i + "xyz".index(lang[0]), t, lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    mine = {r["doc_id"] for r in docs.filter(~langid.held_out(F.col("doc_id"))).collect()}
    model = langid.learn(docs)
    assert model.langs == ["xx", "yy", "zz"]
    counts = {lang: Counter(g for d, t, at in rows if at == lang and d in mine for w in langid.LETTERS.findall(t.lower()) for g in langid.grams(w)) for lang in model.langs}
    kind = lambda g: 4 if g[0] == "=" else len(g)
    every = set().union(*counts.values())
    assert len(model.codes) + len(model.words) == len(every)
    for g in every:
        total = {lang: sum(n for x, n in c.items() if kind(x) == kind(g)) for lang, c in counts.items()}
        mean = sum(counts[lang][g] / total[lang] for lang in counts) / 3
        row = model.rows(g[0] != "=", np.array([langid.mark(g[1:]) if g[0] == "=" else langid.code(g)], np.uint64), kind(g))[0]
        assert row < len(every)
        assert np.allclose(model.weights[row], [np.log((counts[lang][g] + langid.PRIOR * mean) / (total[lang] + langid.PRIOR)) for lang in model.langs], atol=1e-5)


def test_more_languages_than_training_rows(spark):
    rows = [(3 * i, f"wort{i} ab" * 5, f"l{i:02}") for i in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_docs=5)
    assert len(model.langs) == sum(1 for i in range(40) if zlib.crc32(str(3 * i).encode()) % 3 != 1)


def test_of_rows_with_one_id_the_least_text_stays(spark):
    texts = [f"some other words number {i} of a longer text that is like no other {'abc'[i % 3]}{i * 7919}" for i in range(6)]
    rows = [(5, t, "en", "a", len(t)) for t in texts] + [(9, "one two three four five six", "en", "a", 10)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect()}
    assert got == {5: min(texts), 9: "one two three four five six"}


def test_training_texts_without_letters(spark):
    model = langid.learn(spark.createDataFrame([(i, "123 !", "en") for i in range(9)], "doc_id bigint, text string, lang string"))
    docs = spark.createDataFrame([(1, "some words"), (2, "99")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}[2] == "und"


def test_components_take_no_step_where_edges_are_stars(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(neardup, "durable", lambda df: steps.append(1) or df.localCheckpoint())

    def found(edges):
        steps.clear()
        return {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}

    assert found([(5, 2), (2, 7), (2, 5), (9, 8), (3, 3)]) == {2: 2, 5: 2, 7: 2, 8: 8, 9: 8} and len(steps) == 1
    assert found([]) == {} and len(steps) == 1
    assert found([(i, i + 1) for i in range(9)] + [(20, 30), (30, 25)]) == {**dict.fromkeys(range(10), 0), 20: 20, 25: 20, 30: 20} and len(steps) > 1


def test_grams_are_tabled_without_an_object_each():
    langs, grams = ["de", "en"], [f"={i}" for i in range(60_000)]
    n = len(grams)
    counts = pa.table({"lang": ["en", "de"] * (n // 2) + ["de", "en", "en", "de"], "gram": [*grams, "ab", "#latin", "ab", "#greek"], "n": [*range(1, n + 1), 3, 4, 5, 6]})
    tracemalloc.start()
    keys, kind, values, scripts = langid.tabled(counts, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n
    assert kind.tolist() == [2] + [4] * n and keys[0] == langid.code("ab") and (np.diff(keys[1:].astype(object)) > 0).all()
    assert values[0].tolist() == [3, 5] and {k: v.tolist() for k, v in scripts.items()} == {"latin": [False, True], "greek": [True, False]}
    row = 1 + int(np.searchsorted(keys[1:], np.uint64(langid.mark("7"))))
    assert values[row].tolist() == [8, 0]

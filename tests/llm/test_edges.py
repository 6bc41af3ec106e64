"""Every operator and stage over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import ann, knn, langid, mixing, neardup, packing, pii, secrets, sharding, tokencount

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000 + "x" * 50_000
ROWS = [
    (1, "the cat sat on the mat with the dog", "en", "a", 35),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n\t ", None, "b", 5),
    (5, LONG, "en", None, len(LONG)),
    (6, 'password = "abcdefghijkl0123" mail a@b.co', "de", "b", 40),
    (6, 'password = "abcdefghijkl0123" mail a@b.co', "de", "b", 40),
    (7, "der Hund und die Katze 日本 😀 token: 0123456789abcdef0", "de", "c", 30),
    (None, "no id at all here", "en", "c", 17),
    (8, "the cat sat on the mat with the dog", "en", "a", 35),
]
OPERATORS = {
    "pii": pii.scan,
    "secrets": lambda d: secrets.scan(d)[0],
    "mixing": mixing.mix,
    "packing": packing.pack,
    "langid": lambda d: langid.predict(d, langid.learn(d)),
    "tokencount": tokencount.count_tokens,
    "neardup": neardup.dedup,
    "sharding": sharding.shard,
}
CLASHES = ("size", "blob_id", "spans", "atom", "part", "n", "set_id", "node", "cell", "mark", "bin", "target", "score", "length", "keys", "path")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit("extra") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    out = OPERATORS[name](docs)
    got = out.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    if name != "packing":
        assert {r["doc_id"]: r["count"] for r in got}[6] == 2 and out.count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(docs, wide, name):
    plain, other = OPERATORS[name](docs), OPERATORS[name](wide)
    assert plain.columns == other.columns
    assert plain.count() == other.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, wide, stage):
    _, run = corpus_pipeline.STAGES[stage]
    for table in (docs, wide):
        out = run(spark, table, "")
        assert stage == 4 or out.columns == list(corpus_pipeline.COLUMNS)
        assert out.count() > 0
    assert run(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("search", [knn.search, ann.search])
def test_odd_vectors(spark, search):
    rows = [
        (0, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1),
        (6, [1.0, 2.0, 3.0], 1), (7, [0.0, 1.0], 1), (8, [0.0, 1.0], 1), (9, [-1.0, 0.0], 1), (None, [1.0, 1.0], 1),
    ]
    table = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("score", "rank", "cell", "query_id", "leaf", "v")})
    got = {}
    for r in search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [100, 7, 8, 9] and got[100] == [0, 7, 8, 9]
    assert search(spark.createDataFrame([], VECTORS)).count() == 0
    assert search(spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("search", [knn.search, ann.search])
def test_each_length_is_searched(spark, search):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [1.0, 1.0], 1), (20, [1.0, 0.0, 0.0], 1), (21, [2.0, 0.0, 1.0], 1), (40, [7.0], 1)]
    got = {}
    for r in search(spark.createDataFrame(rows, VECTORS), every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [2, 1], 20: [21]}


@pytest.mark.parametrize(("search", "every", "k"), [(knn.search, 100, 10), (lambda t: ann.search(t, share=1.0), 20, 20)])
def test_repeated_vectors(spark, search, every, k):
    """Every row repeated, a query's id with another vector too: each query row has its own whole list."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(130, 4)))]
    rows += [*rows, (100, [1.0, 2.0, 3.0, 4.0]), (20, [0.5, 0.0, 0.0, -1.0])]
    x = np.array([v for _, v in rows])
    whole = np.floor(1024 * x) if every == 100 else x
    want = []
    for i, (q, _) in enumerate(rows):
        if q % every == 0:
            s = {j: float(whole[j] @ whole[i]) for j in range(len(rows)) if rows[j][0] != q}
            order = sorted(s, key=lambda j: (-round(s[j], 9), rows[j][0]))[:k]  # noqa: B023
            want += [(q, n + 1, rows[j][0], round(s[j], 6)) for n, j in enumerate(order)]
    got = search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(float(r["score"]), 6)) for r in got) == sorted(want)

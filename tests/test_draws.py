import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import draws, moments, neighbors
from terrane.sources import tables


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"chain": 1, "iter": np.arange(1, len(x) + 1), "param": "p", "i": 1, "j": 1, "value": x}))


def test_effective_size_by_plain_sums():
    rng = np.random.default_rng(1)
    x = np.empty(300)
    x[0] = 0
    for t in range(1, 300):
        x[t] = 0.7 * x[t - 1] + rng.standard_normal()
    y = x - x.mean()
    rho = np.array([(y[: 300 - k] * y[k:]).sum() for k in range(300)]) / (y * y).sum()
    pairs, total, least = rho[0::2] + rho[1::2], 0.0, np.inf
    for p in pairs:
        if p <= 0:
            break
        least = min(least, p)
        total += least
    assert draws.effective_size(x) == pytest.approx(min(300, 300 / max(1, 2 * total - 1)))
    assert draws.effective_size(np.ones(10)) == 10 and draws.effective_size(x[:3]) == 3


@pytest.mark.parametrize("burn", [None, 0, 1, 5, 40])
def test_running_means(spark, burn):
    x = np.random.default_rng(2).standard_normal(60)
    got = draws.running_mean(frame(spark, x), burn).orderBy("iter").toPandas()["mean"].to_numpy()
    want, m = [], 0.0
    for t, v in enumerate(x, 1):
        a = 1 / t if burn is None else 1.0 if t <= burn else (t - burn) ** -0.65
        m += a * (v - m)
        want.append(m)
    assert np.allclose(got, want)


def test_thinning_rounds_halves_to_even(spark):
    rows = spark.range(1, 5).withColumnRenamed("id", "loc_id")
    assert sorted(r[0] for r in draws.thin(rows, 3, "loc_id").collect()) == [1, 2, 4]
    assert draws.thin(rows, 10, "loc_id").count() == 4
    assert draws.thin(rows.limit(0), 10, "loc_id").count() == 0


def test_tail(spark):
    assert [r["iter"] for r in draws.tail(frame(spark, np.arange(5.0)), 2).orderBy("iter").collect()] == [4, 5]


@pytest.mark.parametrize(
    ("points", "gridded"),
    [
        ([(x, y) for x in range(4) for y in range(3)], True),
        ([(x * 0.1, 5.0) for x in range(6)], True),
        ([(1.0, 1.0)], True),
        ([(x, y) for x in (0, 1, 3) for y in range(3)], False),
        ([(x, y) for x in range(4) for y in range(3)][:-1], False),
        ([(x, y) for x in (0, 1, 2.001) for y in range(2)], False),
    ],
)
def test_grids(spark, points, gridded):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "loc_id bigint, x double, y double")
    assert neighbors.grid_check(p).first()["gridded"] is gridded


def test_missing_outcomes(spark):
    obs = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (2, 1, None), (2, 2, None), (3, 1, 2.0), (3, 2, 3.0)], "loc_id bigint, outcome int, y double")
    got = {r["outcome"]: (r["available"], r["missing"], r["partly"]) for r in moments.missing_map(obs).collect()}
    assert got == {1: (2, 1, 0), 2: (1, 2, 1)}
    assert [r[0] for r in moments.fully_missing(obs).collect()] == [2]
    assert {r["loc_id"] for r in moments.complete_cases(obs).collect()} == {3}


def test_intercept_is_looked_for_among_all_covariates(spark):
    x = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.0, 1.0])], "loc_id bigint, x array<double>")
    assert moments.intercept(x).first()["intercept"] == 2
    assert moments.intercept(x.withColumn("x", F.array(F.lit(2.0)))).first()["intercept"] is None


def test_draws_are_written_by_parameter(spark, tmp_path):
    d = frame(spark, np.arange(4.0)).unionByName(frame(spark, np.arange(3.0)).withColumn("param", F.lit("q")))
    tables.write_draws(d, str(tmp_path / "draws"))
    assert tables.read_draws(spark, str(tmp_path / "draws"), "q").count() == 3
    assert tables.read_draws(spark, str(tmp_path / "draws")).count() == 7

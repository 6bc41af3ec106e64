"""Starting values by Fisher scoring against dense likelihoods."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta, covariance, distances
from terrane.models import api, starting
from terrane.operators import neighbors


def data(n, seed, phi=8.0, ratio=0.3, nu=0.5):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2))
    k = covariance(distances(xy, xy), Theta(phi, 1.0, nu, 0.0)) + ratio * np.eye(n)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = x @ [1.0, -0.5] + np.linalg.cholesky(k) @ rng.standard_normal(n)
    return xy, x, y


def dense(xy, x, y, z, nu):
    """Profile likelihood of all places at once."""
    t = starting.theta_of(z, nu)
    c = np.linalg.cholesky(covariance(distances(xy, xy), t))
    hx, hy = np.linalg.solve(c, x), np.linalg.solve(c, y)
    e = hy - hx @ np.linalg.lstsq(hx, hy, rcond=None)[0]
    return -0.5 * len(y) * np.log(e @ e / len(y)) - np.log(np.diag(c)).sum()


def best(f, z, step=0.5):
    """By ever finer moves along and between the axes."""
    value = f(z)
    while step > 2e-6:
        moves = [m * step for m in np.array(np.meshgrid(*[[-1, 0, 1]] * len(z))).reshape(len(z), -1).T if m.any()]
        tried = [(f(z + m), tuple(z + m)) for m in moves]
        top = max(tried)
        if top[0] > value:
            value, z = top[0], np.array(top[1])
        else:
            step /= 2
    return z, value


def tables(spark, xy, x, ys):
    n = len(xy)
    locs = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]}))
    obs = spark.createDataFrame([(i, j + 1, None if np.isnan(y[i]) else float(y[i])) for j, y in enumerate(ys) for i in range(n)], "loc_id bigint, outcome int, y double")
    return locs, obs, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "loc_id bigint, x array<double>")


def rows_of(spark, xy, x, y, m):
    locs, obs, design = tables(spark, xy, x, [y])
    return starting.families(locs, obs, design, neighbors.ordered_knn(locs, m).withColumn("outcome", F.lit(1))).persist()


@pytest.mark.parametrize("nu", [0.5, 1.5])
def test_optimum_is_that_of_the_dense_likelihood(spark, nu):
    xy, x, y = data(120, 1, nu=nu)
    got, steps = starting.fit(rows_of(spark, xy, x, y, 119), [1], nu)[1]
    z, value = best(lambda z: dense(xy, x, y, z, nu), np.log([got.phi * 1.3, got.ratio * 0.7]))
    assert steps < 20
    assert dense(xy, x, y, np.log([got.phi, got.ratio]), nu) == pytest.approx(value, abs=1e-5)
    assert np.allclose(np.log([got.phi, got.ratio]), z, atol=2e-3)


def test_gradient_and_information_are_those_of_the_likelihood(spark):
    xy, x, y = data(60, 2)
    rows = rows_of(spark, xy, x, y, 8)
    z = np.array([1.8, -0.7, 0.3])
    p = starting.evaluate(rows, {1: z}, None, 1)[1]
    for i in range(3):
        e = np.eye(3)[i] * 1e-3
        up, down = (starting.evaluate(rows, {1: z + s}, None, 1)[1].value for s in (e, -e))
        assert p.gradient[i] == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-4)
    assert (np.linalg.eigvalsh(p.information) > 0).all()


def test_missing_outcomes_are_left_out(spark):
    """As if the places without it were not there; filling them would pull the variance down."""
    xy, x, y = data(300, 3)
    gone = np.arange(300) % 3 == 0
    locs, obs, design = tables(spark, xy, x, [np.where(gone, np.nan, y), y])
    ranks = neighbors.ranked(locs).select("loc_id", "ord")
    got = api.auto_start(locs, obs, design, neighbors.ordered_knn(locs, 10), ranks, m=10)
    keep = ~gone
    some = tables(spark, xy[keep], x[keep], [y[keep]])
    alone = api.auto_start(*some, neighbors.ordered_knn(some[0], 10), neighbors.ranked(some[0]).select("loc_id", "ord"), m=10)
    assert got["thetas"][0].phi == pytest.approx(alone["thetas"][0].phi, rel=1e-4)
    assert got["sigma"][0, 0] == pytest.approx(alone["sigma"][0, 0], rel=1e-4)
    assert got["beta"].shape == (2, 2) and got["beta"][:, 0] == pytest.approx(alone["beta"][:, 0], abs=1e-4)


def test_fits_start_by_themselves(spark):
    xy, x, y = data(150, 4)
    locs, obs, design = tables(spark, xy, x, [y, y[::-1].copy()])
    fit = api.fit(locs, obs, design, m=6, iters=3)
    assert fit.draws.filter("param = 'Theta' and i = 1 and value > 0").count() == 3 * 2
    vi = api.fit(locs, obs, design, m=6, method="vi")
    assert vi.draws.filter("param = 'Beta'").count() == 4
    over = api.fit(locs, obs, design, m=6, iters=2, tiles=2, model="latent")
    assert over.draws.filter("param = 'W'").count() == 2 * 2 * 150

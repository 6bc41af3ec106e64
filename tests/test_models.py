"""Statistical checks of the samplers on simulated data, with the tolerances of the model's published test cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta, covariance, distances
from terrane.models import api, predict, sampler
from terrane.models.linalg import Graph
from terrane.operators import neighbors, vecchia
from terrane.operators.neighbors import max_min_order


def simulated(n, q, rho, sd, seed, gone=0.0):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2))
    xy = xy[max_min_order(xy)]
    sigma = np.full((q, q), rho) + (1 - rho) * np.eye(q)
    thetas = [Theta(p, 1.0, 1.5, 0.0) for p in np.linspace(6, 12, q)]
    white = rng.standard_normal((n, q)) @ np.linalg.cholesky(sigma).T
    d = distances(xy, xy)
    w = np.column_stack([np.linalg.cholesky(covariance(d, t) + 1e-6 * np.eye(n)) @ white[:, j] for j, t in enumerate(thetas)])
    y = w + sd * rng.standard_normal((n, q))
    y[rng.random((n, q)) < gone] = np.nan
    return xy, y, sigma, thetas


def graph_of(xy, m):
    d = distances(xy, xy)
    return Graph(xy, [list(np.argsort(d[i, :i], kind="stable")[:m]) for i in range(len(xy))])


def state_of(xy, y, thetas, m, sd, **options):
    q = y.shape[1]
    o = sampler.Options(latent=True, **options)
    return sampler.State(y, np.ones((len(y), 1)), graph_of(xy, m), thetas, np.zeros((1, q)), np.eye(q), np.full(q, sd**2), o, np.where(np.isfinite(y), y, 0.0))


def check(draws, sigma, sd, kept):
    s, d = draws["Sigma"][kept:].mean(0), draws["Ddiag"][kept:, :, 0].mean(0)
    assert all(np.isfinite(v).all() for v in draws.values())
    assert np.abs(np.diag(s) - np.diag(sigma)).max() < 0.6
    assert np.abs(d - sd**2).max() < 0.1
    return s


def test_block_sampler():
    xy, y, sigma, thetas = simulated(300, 3, 0.7, 0.3, 42)
    s = check(sampler.run_chain(state_of(xy, y, thetas, 15, 0.3), 40, np.random.default_rng(1)), sigma, 0.3, 20)
    assert s[0, 1] / np.sqrt(s[0, 0] * s[1, 1]) > 0.3


def test_samplers_and_preconditioners_agree():
    xy, y, sigma, thetas = simulated(200, 2, 0.4, 0.3, 23, gone=0.05)
    got = []
    for options, n in (({"preconditioner": "jacobi"}, 80), ({"preconditioner": "posterior"}, 80), ({"sampler": sampler.OUTCOME}, 120), ({"sampler": sampler.SITE}, 80)):
        draws = sampler.run_chain(state_of(xy, y, thetas, 12, 0.3, **options), n, np.random.default_rng(5))
        got.append((check(draws, sigma, 0.3, n // 2), draws["Ddiag"][n // 2 :, :, 0].mean(0)))
    for s, d in got[1:]:
        assert np.abs(s - got[0][0]).max() < 0.4 and np.abs(d - got[0][1]).max() < 0.05


def test_one_seed_gives_one_chain():
    xy, y, _, thetas = simulated(120, 2, 0.3, 0.3, 7)
    a, b = (sampler.run_chain(state_of(xy, y, list(thetas), 10, 0.3), 10, np.random.default_rng(99)) for _ in range(2))
    assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_block_update_draws_from_the_conditional():
    """Mean and spread of (B, W) against dense algebra."""
    xy, y, sigma, thetas = simulated(25, 2, 0.5, 0.5, 3, gone=0.1)
    s = state_of(xy, y, thetas, 24, 0.5, preconditioner="jacobi")
    s.sigma, s.q_matrix = sigma, np.linalg.inv(sigma)
    n, q = y.shape
    hs = [f.dense() for f in s.factors]
    prior = np.block([[s.q_matrix[i, j] * hs[i].T @ hs[j] for j in range(q)] for i in range(q)])
    d = np.where(s.there, 1 / s.noise, 0).T.ravel()
    x = np.kron(np.eye(q), s.x)
    top = sampler.PRIOR_B * np.eye(q) + x.T @ (d[:, None] * x)
    precision = np.block([[top, x.T * d], [d[:, None] * x, prior + np.diag(d)]])
    e = np.where(s.there, y, 0).T.ravel() * d
    mean = np.linalg.solve(precision, np.concatenate([x.T @ e, e]))
    rng, draws = np.random.default_rng(2), []
    for _ in range(1500):
        s.update_block(rng)
        draws.append(np.concatenate([s.beta.ravel(), s.w.T.ravel()]))
    sd = np.sqrt(np.diag(np.linalg.inv(precision)))
    assert np.abs((np.mean(draws, 0) - mean) / sd).max() < 0.16
    assert np.abs(np.std(draws, 0) / sd - 1).max() < 0.12


def test_imputation_is_the_conditional_mean():
    xy, y, sigma, thetas = simulated(30, 2, 0.5, 0.0, 4)
    y[5, 1] = np.nan
    o = sampler.Options(latent=False, clamp=False)
    s = sampler.State(y, np.ones((30, 1)), graph_of(xy, 29), thetas, np.zeros((1, 2)), sigma, np.ones(2), o)
    hs = [f.dense() for f in s.factors]
    precision = np.block([[s.q_matrix[i, j] * hs[i].T @ hs[j] for j in range(2)] for i in range(2)])
    z, at = np.where(np.isfinite(y), y, 0).T.ravel(), 35
    own = -(precision[at] @ z - precision[at, at] * z[at]) / precision[at, at]
    rng, got = np.random.default_rng(1), []
    for _ in range(800):
        s.impute(rng)
        got.append(s.full[5, 1])
    sd = precision[at, at] ** -0.5
    assert abs(np.mean(got) - own) < 0.15 * sd and abs(np.std(got) / sd - 1) < 0.12


def test_variational_means_are_near_the_chains():
    xy, y, sigma, thetas = simulated(200, 2, 0.5, 0.3, 11)
    chain = sampler.run_chain(state_of(xy, y, list(thetas), 12, 0.3), 80, np.random.default_rng(3))
    vi = sampler.run_latent_vi(state_of(xy, y, list(thetas), 12, 0.3), np.random.default_rng(4), tol=0.03)
    assert np.abs(vi["Sigma"] - chain["Sigma"][40:].mean(0)).max() < 0.5
    assert np.sqrt(((vi["W"] - chain["W"][40:].mean(0)) ** 2).mean()) < 0.2


def frames(spark, xy, y):
    n, q = y.shape
    locs = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]}))
    rows = [(i, j + 1, float(y[i, j]) if np.isfinite(y[i, j]) else None) for i in range(n) for j in range(q)]
    return locs, spark.createDataFrame(rows, "loc_id bigint, outcome int, y double"), locs.select("loc_id", F.array(F.lit(1.0)).alias("x"))


def test_fit_from_tables(spark):
    xy, y, sigma, _ = simulated(120, 2, 0.5, 0.2, 8, gone=0.05)
    tables = frames(spark, xy, y)
    fit = api.fit(*tables, m=8, iters=25, chains=2)
    counts = {(r["chain"], r["param"]): r["n"] for r in fit.draws.groupBy("chain", "param").agg(F.countDistinct("iter").alias("n")).collect()}
    assert counts[1, "Beta"] == counts[2, "Sigma"] == 25
    vi = api.fit(*tables, m=8, method="vi")
    got = {(r["i"], r["j"]): r["value"] for r in vi.draws.filter("param = 'Sigma'").collect()}
    assert got[1, 2] == pytest.approx(got[2, 1]) and got[1, 1] > 0 and vi.info["dropped"] > 0
    with pytest.raises(ValueError):
        api.fit(*tables, model="other")


def test_simulated_covariance(spark):
    rng = np.random.default_rng(1)
    locs = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(400), "x": rng.random(400) * 100, "y": rng.random(400) * 100}))
    sigma = np.array([[1.0, 0.6], [0.6, 2.0]])
    y = api.simulate(locs, sigma, (Theta(6.0), Theta(9.0))).toPandas().pivot(index="loc_id", columns="outcome", values="y").to_numpy()
    assert np.allclose(np.cov(y.T), sigma, atol=0.35) and np.abs(y.mean(0)).max() < 1e-9
    with pytest.raises(ValueError):
        api.simulate(locs, np.array([[1.0, 2.0], [2.0, 1.0]]), (Theta(6.0), Theta(9.0)))


def test_location_without_outcomes_needs_the_block_sampler():
    xy, y, _, thetas = simulated(30, 2, 0.5, 0.2, 8)
    y[3] = np.nan
    with pytest.raises(ValueError):
        state_of(xy, y, thetas, 5, 0.2, sampler=sampler.OUTCOME)
    state_of(xy, y, thetas, 5, 0.2)




def small_tables(spark, n=60, missing=()):
    rng = np.random.default_rng(5)
    xy, y = rng.uniform(size=(n, 2)), rng.normal(size=(n, 2))
    locs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "loc_id bigint, x double, y double")
    obs = spark.createDataFrame([(i, j + 1, None if (i, j + 1) in missing else float(y[i, j])) for i in range(n) for j in range(2)], "loc_id bigint, outcome int, y double")
    design = spark.createDataFrame([(i, [1.0, float(xy[i, 0])]) for i in range(n)], "loc_id bigint, x array<double>")
    return locs, obs, design


START = {"beta": np.zeros((2, 2)), "sigma": np.eye(2), "thetas": [(6.0, 1.0, 0.5, 0.1)] * 2, "noise": np.full(2, 0.1)}


def test_imputed_cells_are_named_and_predicted_from(spark):
    gone = {(3, 1), (7, 2), (11, 1), (11, 2)} - {(11, 2)}
    locs, obs, design = small_tables(spark, missing=gone)
    fit = api.fit(locs, obs, design, m=5, iters=6, chains=2, start=START)
    fit.draws = fit.draws.persist()
    got = api.imputed(fit).toPandas()
    assert set(zip(got["loc_id"], got["outcome"])) == gone and len(got) == 3 * 6 * 2
    new = spark.createDataFrame([(1000, 0.5, 0.5), (1001, 0.1, 0.9)], "loc_id bigint, x double, y double")
    x_new = spark.createDataFrame([(1000, [1.0, 0.5]), (1001, [1.0, 0.1])], "loc_id bigint, x array<double>")
    out = api.predict(fit, locs, obs, design, new, x_new, burn=2, every=2, noise=False).toPandas()
    assert len(out) == 2 * 4 * 2 and np.isfinite(out["value"]).all()
    # One draw by hand: its own imputed values stand for what is missing.
    params = fit.draws.filter("chain = 1 and iter = 3").toPandas()
    beta, theta = (params[params["param"] == k].pivot(index="i", columns="j", values="value").to_numpy() for k in ("Beta", "Theta"))
    full = {(r["loc_id"], r["outcome"]): r["y"] for r in obs.collect()} | {(r.loc_id, r.outcome): r.value for r in got[(got["chain"] == 1) & (got["iter"] == 3)].itertuples()}
    draw = predict.Draw(beta, np.eye(2), tuple(Theta(*t) for t in theta.T))
    whole = spark.createDataFrame([(i, j, float(v)) for (i, j), v in full.items()], "loc_id bigint, outcome int, y double")
    want = predict.response(locs, whole, design, new, x_new, [draw], 5, noise=False).toPandas().set_index(["loc_id", "outcome"])["value"]
    assert all(want[r.loc_id, r.outcome] == pytest.approx(r.value) for r in out[out["draw"] == 1].itertuples())
    with pytest.raises(ValueError, match="missing"):
        predict.response(locs, obs, design, new, x_new, [draw], 5)


def test_latent_fits_are_predicted_from(spark):
    locs, obs, design = small_tables(spark)
    for method, draws in (("mcmc", 4), ("vi", 1)):
        fit = api.fit(locs, obs, design, m=5, iters=4, model="latent", method=method, start=START)
        fit.draws = fit.draws.persist()
        out = api.predict(fit, locs, obs, design, locs.limit(7), design).toPandas()
        assert len(out) == 7 * draws * 2 and np.isfinite(out["value"]).all()


def test_noise_of_predictions_has_its_spread(spark):
    locs, obs, design = small_tables(spark)
    new = spark.createDataFrame([(1000, 5.0, 5.0)], "loc_id bigint, x double, y double")  # far from all: the process's own spread
    x_new = spark.createDataFrame([(1000, [0.0, 0.0])], "loc_id bigint, x array<double>")
    sigma = np.array([[1.0, 0.6], [0.6, 2.0]])
    draws = [predict.Draw(np.zeros((2, 2)), sigma, (Theta(9.0), Theta(9.0)))] * 4000
    out = predict.response(locs, obs, design, new, x_new, draws, 5).toPandas().pivot(index="draw", columns="outcome", values="value").to_numpy()
    assert np.allclose(np.cov(out.T), sigma, atol=0.12)
    known = spark.createDataFrame([(1000, 1, 1.5)], "loc_id bigint, outcome int, y double")
    part = predict.response(locs, obs, design, new, x_new, draws, 5, partly=known).toPandas().pivot(index="draw", columns="outcome", values="value").to_numpy()
    assert (part[:, 0] == 1.5).all() and part[:, 1].mean() == pytest.approx(0.9, abs=0.1) and part[:, 1].var() == pytest.approx(2 - 0.36, abs=0.15)


def test_order_by_levels_spreads_each_prefix(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(size=(900, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "loc_id bigint, x double, y double")
    got = neighbors.level_order(points).toPandas().sort_values("ord")
    assert got["ord"].tolist() == list(range(900)) and sorted(got["loc_id"]) == list(range(900))
    exact, near = neighbors.max_min_order(xy), got["loc_id"].to_numpy()
    for n in (20, 80, 300):
        reach = [np.sqrt(((xy[:, None] - xy[o[:n]][None]) ** 2).sum(2)).min(1).max() for o in (exact, near)]
        assert reach[1] < 3 * reach[0]
    assert neighbors.level_order(points.limit(0)).count() == 0


def test_build_and_nuggets(spark):
    locs, _, _ = small_tables(spark)
    built = vecchia.build(locs, [Theta(6.0), Theta(9.0)], m=4, nugget=[0.0, 0.5])
    dets = {r["outcome"]: r[1] for r in built.log_determinant.orderBy("outcome").collect()}
    assert len(dets) == 2 and built.blankets.count() == 60 and built.precision.count() > 60 and built.edges.count() == built.h.filter("outcome = 1").count() - 60
    with_nugget = built.factors.filter("outcome = 2").agg({"sqrt_r": "max"}).first()[0]
    assert with_nugget == pytest.approx(np.sqrt(1.5), abs=0.05)


def test_fit_on_a_grid_and_its_timings(spark):
    """Rows of a grid as order and graph; phases of sweeps are timed on request and nothing else of the draws changes."""
    n, wide = 48, 8
    rng = np.random.default_rng(3)
    locs = spark.createDataFrame([(i, 0.1 * (i % wide), 0.1 * (i // wide)) for i in reversed(range(n))], "loc_id bigint, x double, y double")
    obs = spark.createDataFrame([(i, j, float(v)) for i in range(n) for j, v in ((1, rng.normal()), (2, rng.normal()))], "loc_id bigint, outcome int, y double")
    design = spark.createDataFrame([(i, [1.0]) for i in range(n)], "loc_id bigint, x array<double>")
    start = {"beta": np.zeros((1, 2)), "sigma": np.eye(2), "thetas": [(8.0, 1.0, 0.5, 0.0), (8.0, 1.0, 0.5, 0.0)]}
    plain = api.fit(locs, obs, design, m=4, iters=3, start=start, order="grid")
    timed = api.fit(locs, obs, design, m=4, iters=3, start=start, order="grid", timings=True)
    assert {(r.loc_id, r.ord) for r in plain.places.collect()} == {(i, i) for i in range(n)}
    edges = {(r.node, r.parent) for r in plain.edges.collect()}
    assert edges == {(r.node, r.parent) for r in neighbors.grid_dag(locs.selectExpr("loc_id", "int(loc_id % 8) gx", "int(loc_id div 8) gy"), 4).collect()}
    a = {(r.iter, r.param, r.i, r.j): r.value for r in plain.draws.collect()}
    b = {(r.iter, r.param, r.i, r.j): r.value for r in timed.draws.collect()}
    seconds = {k: b.pop(k) for k in list(b) if k[1] == "Seconds"}
    assert a == b
    assert len(seconds) == len(timed.info["phases"]) and all(v >= 0 for v in seconds.values()) and sum(seconds.values()) > 0
    with pytest.raises(ValueError):
        api.fit(locs.filter("loc_id != 9"), obs.filter("loc_id != 9"), design.filter("loc_id != 9"), m=4, iters=1, start=start, order="grid")


def test_moments_are_those_of_dense_algebra(spark):
    xy, y, _, thetas = simulated(50, 2, 0.5, 0.2, 8)
    locs, obs, _ = frames(spark, xy, y)
    x = np.column_stack([np.ones(50), xy[:, 0]])
    design = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "loc_id bigint, x array<double>")
    xx, xy_, yy, n = api.vi_moments(locs, obs, design, neighbors.ordered_knn(locs, 6), thetas, 1)
    graph = graph_of(xy, 6)
    hs = [graph.factor(t).dense() for t in thetas]
    assert n == 50
    for a in range(2):
        for b in range(2):
            assert np.allclose(xx[a, b], (hs[a] @ x).T @ (hs[b] @ x))
            assert np.allclose(xy_[a, b], (hs[a] @ x).T @ (hs[b] @ y[:, b]))
            assert yy[a, b] == pytest.approx((hs[a] @ y[:, a]) @ (hs[b] @ y[:, b]))


def test_means_refuse_neighbours_without_a_value(spark):
    locs, obs, _ = small_tables(spark, missing={(3, 1)})
    fixed = locs.select("loc_id", F.lit(1).alias("outcome"), F.lit(0.0).alias("f"))
    values = obs.filter("outcome = 1").select("loc_id", "outcome", F.col("y").alias("a"))
    new = locs.filter("loc_id = 3").select(F.lit(900).cast("long").alias("loc_id"), "x", "y")
    for given in (values, values.filter("a is not null")):
        with pytest.raises(Exception, match="imputed first"):
            predict.mean(locs, new, given, fixed.withColumn("loc_id", F.lit(900).cast("long")).distinct(), [Theta(6.0)], 4).collect()


def test_grids_are_recognised(spark):
    rng = np.random.default_rng(3)
    locs = spark.createDataFrame([(i, 0.1 * (i % 8), 0.1 * (i // 8)) for i in range(40)], "loc_id bigint, x double, y double")
    obs = spark.createDataFrame([(i, 1, float(rng.normal())) for i in range(40)], "loc_id bigint, outcome int, y double")
    design = spark.createDataFrame([(i, [1.0]) for i in range(40)], "loc_id bigint, x array<double>")
    start = {"beta": np.zeros((1, 1)), "sigma": np.eye(1), "thetas": [(8.0, 1.0, 0.5, 0.1)]}
    assert api.fit(locs, obs, design, m=4, iters=1, start=start).info["order"] == "grid"
    some = [t.filter("loc_id != 9") for t in (locs, obs, design)]
    assert api.fit(*some, m=4, iters=1, start=start).info["order"] == "maxmin"

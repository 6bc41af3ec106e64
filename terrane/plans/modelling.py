"""Queries of fitting, simulation and prediction. Means and moments have SQL; what is drawn at random has none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta
from terrane.models import api, predict, sampler, starting
from terrane.operators import draws, moments, neighbors
from terrane.plans.relational import BETA, ENTRIES, OBS, SPLIT, Query, nn, r, rounded, vecchia2
from terrane.sources import fixtures as fx

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DRAW = predict.Draw(np.array([BETA[j] for j in (1, 2, 3)]).T, np.array(fx.SIGMA), fx.THETAS, np.array([0.01, 0.01, 0.01]))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


FIT = "(CASE o.outcome WHEN 1 THEN 0.1 WHEN 2 THEN -0.2 ELSE 0.0 END + c1 * CASE o.outcome WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE -0.7 END)"
NEW = (
    f"WITH {SPLIT}, {nn(2, 'train', 'fresh')}, {vecchia2(fx.THETAS, 'train', 'fresh')}, obs AS (SELECT loc_id, c1, unnest([1, 2, 3]) AS outcome, unnest([z1, z2, z3]) AS y FROM irr), "
    f"res AS (SELECT loc_id, outcome, y, {FIT} AS f, y - {FIT} AS e FROM obs o), "
    "k AS (SELECT fac.outcome, node AS loc_id, f.f, f.y, r2, f.f + coalesce(h1 * a.e, 0) + coalesce(h2 * b.e, 0) AS mean, f.f + coalesce(h1 * a.y, 0) + coalesce(h2 * b.y, 0) AS latent FROM fac JOIN res f ON f.loc_id = node AND f.outcome = fac.outcome "
    "LEFT JOIN res a ON a.loc_id = p1 AND a.outcome = fac.outcome LEFT JOIN res b ON b.loc_id = p2 AND b.outcome = fac.outcome)"
)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training places, new places, and all outcomes."""
    p = fx.points(spark, sf_dir)
    return p.filter("loc_id % 10 != 0"), p.filter("loc_id % 10 = 0"), fx.outcomes(spark, sf_dir)


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = fx.outcomes(spark, sf_dir).withColumn("y", F.lit(0.0))
    return moments.residual(zero, fx.covariates(spark, sf_dir), BETA).select("loc_id", "outcome", (-F.col("e")).alias("f"))


@query("predict_mean", f"{NEW} SELECT loc_id, outcome, {r('mean', 'mean')}, {r('sqrt(r2)', 'sd')} FROM k")
def predict_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional means at new places, all in joins and sums."""
    train, new, _ = _split(spark, sf_dir)
    e = moments.residual(fx.outcomes(spark, sf_dir), fx.covariates(spark, sf_dir), BETA).withColumnRenamed("e", "a")
    return predict.mean(train, new, e, _fixed(spark, sf_dir), fx.THETAS, 2).select("loc_id", "outcome", rounded("mean", "mean"), rounded("sd", "sd"))


@query("predict_response", f"{NEW} SELECT loc_id, 1 AS draw, outcome, {r('mean', 'value')} FROM k")
def predict_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the sampler's way of prediction, without its noise."""
    train, new, obs = _split(spark, sf_dir)
    x = fx.covariates(spark, sf_dir)
    return predict.response(train, obs, x, new, x, [DRAW], 2, noise=False).select("loc_id", "draw", "outcome", rounded("value", "value"))


@query("predict_from_fit", f"{NEW} SELECT loc_id, draw, outcome, {r('mean', 'value')} FROM k CROSS JOIN (SELECT unnest([1, 2]) AS draw)")
def predict_from_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the draws of a fit, here two iterations of one draw, of which the first two are left out."""
    train, new, obs = _split(spark, sf_dir)
    x = fx.covariates(spark, sf_dir)
    rows = api.long(1, {"Beta": np.stack([0 * DRAW.beta] * 2 + [DRAW.beta] * 2), "Sigma": np.stack([DRAW.sigma] * 4), "Theta": np.stack([np.array(DRAW.thetas).T] * 4)})
    fitted = api.Fit(spark.createDataFrame(rows, api.DRAWS), None, neighbors.ranked(train).select("loc_id", "ord"), {"model": "response", "m": 2, "family": 1})
    return api.predict(fitted, train, obs, x, new, x, burn=2, noise=False).select("loc_id", "draw", "outcome", rounded("value", "value"))


@query(
    "predict_partial",
    f"{NEW}, o2 AS (SELECT loc_id, y, mean, r2 FROM k WHERE outcome = 2) SELECT k.loc_id, 1 AS draw, outcome, {r('CASE WHEN outcome = 2 THEN k.y ELSE k.mean + sqrt(k.r2) * 0.5 / sqrt(o2.r2) * (o2.y - o2.mean) END', 'value')} FROM k JOIN o2 USING (loc_id)",
)
def predict_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one outcome is known at the new places."""
    train, new, obs = _split(spark, sf_dir)
    x = fx.covariates(spark, sf_dir)
    known = obs.filter("outcome = 2")
    return predict.response(train, obs, x, new, x, [DRAW], 2, noise=False, partly=known).select("loc_id", "draw", "outcome", rounded("value", "value"))


@query("predict_latent", f"{NEW} SELECT loc_id, 1 AS draw, outcome, {r('latent', 'value')} FROM k")
def predict_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes standing for a draw of the process."""
    train, new, obs = _split(spark, sf_dir)
    w = obs.select("loc_id", F.lit(1).alias("draw"), "outcome", F.col("y").alias("w"))
    return predict.latent(train, w, new, fx.covariates(spark, sf_dir), [DRAW], 2, noise=False).select("loc_id", "draw", "outcome", rounded("value", "value"))


@query("predict_response_draws")
def predict_response_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new, obs = _split(spark, sf_dir)
    x = fx.covariates(spark, sf_dir)
    return predict.response(train, obs, x, new, x, [DRAW] * 20, 10)


@query("simulate_mean", "SELECT outcome, CAST(n AS BIGINT) AS n, 0.0 AS mean FROM (SELECT unnest([1, 2, 3]) AS outcome), (SELECT count(*) AS n FROM embeddings)")
def simulate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated outcomes have mean 0."""
    y = api.simulate(fx.points(spark, sf_dir), np.array(fx.SIGMA), fx.THETAS, m=10)
    return y.groupBy("outcome").agg(F.count("y").alias("n"), rounded(F.avg("y"), "mean"))


@query("simulate")
def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.simulate(fx.points(spark, sf_dir), np.array(fx.SIGMA), fx.THETAS, m=10)


ONE = (Theta(6.0),)


@query(
    "vi_response_one",
    f"WITH RECURSIVE {OBS}, {nn(2)}, {vecchia2(ONE)}, {ENTRIES}, wx AS (SELECT i, sum(v) AS a, sum(v * z1) AS b FROM h JOIN irr ON loc_id = j GROUP BY i), m AS (SELECT sum(a * a) AS xx, sum(a * b) AS xy, sum(b * b) AS yy, count(*) AS n FROM wx), "
    "it(k, beta, var, sigma) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, xy / sigma / (xx / sigma + 0.001), 1 / (xx / sigma + 0.001), "
    "(1 + yy - 2 * xy / sigma / (xx / sigma + 0.001) * xy + pow(xy / sigma / (xx / sigma + 0.001), 2) * xx + xx / (xx / sigma + 0.001)) / (n - 1) FROM it, m WHERE k < 60) "
    f"SELECT {r('beta', 'beta')}, {r('var', 'variance')}, {r('sigma', 'sigma')} FROM it WHERE k = 60",
)
def vi_response_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome, one covariate: the moments in one Spark job, the steps on them alone."""
    p = fx.points(spark, sf_dir)
    y, x = fx.outcomes(spark, sf_dir).filter("outcome = 1"), p.select("loc_id", F.array(F.lit(1.0)).alias("x"))
    got = sampler.response_vi(*api.vi_moments(p, y, x, neighbors.ordered_knn(p, 2), ONE, 1), np.eye(1), tol=0.0, most=60)
    row = [float(got["Beta"][0, 0]), float(got["Beta_UQ"][0, 0]), float(got["Sigma"][0, 0])]
    return spark.createDataFrame([row], "beta double, variance double, sigma double").select(*(rounded(c, c) for c in ("beta", "variance", "sigma")))


START = {"beta": np.zeros((2, 3)), "sigma": np.eye(3) * 0.02, "thetas": fx.THETAS, "noise": np.full(3, 0.01)}


def _fit(spark: SparkSession, sf_dir: str, missing: bool = False, **options) -> DataFrame:
    obs = fx.outcomes_missing(spark, sf_dir) if missing else fx.outcomes(spark, sf_dir)
    return api.fit(fx.points(spark, sf_dir), obs, fx.covariates(spark, sf_dir), m=8, **({"start": START, "iters": 20} | options)).draws


@query("fit_response_mcmc")
def fit_response_mcmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, missing=True, chains=2)


@query("fit_response_vi")
def fit_response_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, missing=True, method="vi")


@query("fit_latent_block")
def fit_latent_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, missing=True, model="latent", iters=12)


@query("fit_latent_site")
def fit_latent_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, missing=True, model="latent", sampler_name=sampler.SITE, iters=5)


@query("fit_latent_outcome")
def fit_latent_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, missing=True, model="latent", sampler_name=sampler.OUTCOME, iters=12)


@query("fit_latent_vi")
def fit_latent_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, missing=True, model="latent", method="vi", tol=0.1, predictive=5)


@query("posterior_ess")
def posterior_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective sizes of a fit's draws."""
    return draws.ess(_fit(spark, sf_dir, iters=40).filter("param in ('Beta', 'Sigma', 'Theta')"))


@query("auto_start")
def auto_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir).persist()
    ranks = neighbors.ranked(p).select("loc_id", "ord").persist()
    got = api.auto_start(p, fx.outcomes(spark, sf_dir), fx.covariates(spark, sf_dir), neighbors.ordered_knn(p, 8), ranks, m=8)
    rows = [(j + 1, t.phi, t.nu, t.alpha, float(got["sigma"][j, j]), float(got["noise"][j]), got["beta"][:, j].tolist()) for j, t in enumerate(got["thetas"])]
    return spark.createDataFrame(rows, "outcome int, phi double, nu double, alpha double, sigma double, noise double, beta array<double>")


@query("starting_mapping", "SELECT outcome, CAST(phi AS DOUBLE) AS phi, CAST(alpha AS DOUBLE) AS alpha, CAST(sigma AS DOUBLE) AS sigma, CAST(noise AS DOUBLE) AS noise FROM (VALUES (1, 4.0, 0.2, 2.5, 0.5), (2, 8.0, 0.5, 2.0, 1.0)) t(outcome, phi, alpha, sigma, noise)")
def starting_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From univariate fits (variance 2 and 1, noise ratios 1/4 and 1) to a start."""
    fits = [starting.Univariate(np.zeros(1), 2.0, 4.0, 0.5, 0.25), starting.Univariate(np.zeros(1), 1.0, 8.0, 0.5, 1.0)]
    got = starting.starting_values(fits, False)
    rows = [(j + 1, t.phi, float(t.alpha), float(got["sigma"][j, j]), float(got["noise"][j])) for j, t in enumerate(got["thetas"])]
    return spark.createDataFrame(rows, "outcome int, phi double, alpha double, sigma double, noise double")

"""Masks, residuals and moments of outcomes: what samplers and variational steps need of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_cases(obs: DataFrame) -> DataFrame:
    """Rows of obs (loc_id, outcome, y) of locations where no outcome is missing."""
    q = obs.select("outcome").distinct().agg(F.count("*").alias("q"))
    full = obs.groupBy("loc_id").agg(F.count("y").alias("n")).crossJoin(F.broadcast(q)).filter("n = q").select("loc_id")  # q is one row
    return obs.join(full, "loc_id", "left_semi")


def missing_map(obs: DataFrame) -> DataFrame:
    """For each outcome: rows available, missing, missing where another outcome is there."""
    by_loc = obs.withColumn("some", F.count("y").over(Window.partitionBy("loc_id")) > 0)
    gone = F.col("y").isNull()
    return by_loc.groupBy("outcome").agg(
        F.count("y").alias("available"), F.sum(gone.cast("long")).alias("missing"), F.sum((gone & F.col("some")).cast("long")).alias("partly")
    )


def fully_missing(obs: DataFrame) -> DataFrame:
    """Locations without any outcome; only the block sampler takes them."""
    return obs.groupBy("loc_id").agg(F.count("y").alias("n")).filter("n = 0").select("loc_id")


def dot(x: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(0.0), lambda a, u: a + u)


def residual(obs: DataFrame, design: DataFrame, beta: dict[int, list[float]]) -> DataFrame:
    """y - x'beta by outcome: loc_id, outcome, e."""
    b = F.create_map(*(c for j, v in beta.items() for c in (F.lit(j), F.array(*map(F.lit, map(float, v))))))
    return obs.join(design, "loc_id").select("loc_id", "outcome", (F.col("y") - dot(F.col("x"), b[F.col("outcome")])).alias("e"))


def intercept(design: DataFrame) -> DataFrame:
    """The first covariate that is 1 everywhere, from 1, or null: one row."""
    each = design.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.bool_and(F.col("v") == 1).alias("ones"))
    return each.agg(F.min(F.when(F.col("ones"), F.col("j") + 1)).cast("int").alias("intercept"))


def gram(v: DataFrame) -> DataFrame:
    """V'V for v (outcome, loc_id, v): i, j, g with i <= j, and n rows."""
    a = v.select("loc_id", F.col("outcome").alias("i"), F.col("v").alias("a"))
    b = v.select("loc_id", F.col("outcome").alias("j"), F.col("v").alias("b"))
    return a.join(b, "loc_id").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.count("*").alias("n"))


def sigma_scale(v: DataFrame, q: int) -> DataFrame:
    """The scale I + V'V of the Wishart step and its degrees of freedom n + q: i, j, scale, df."""
    return gram(v).select("i", "j", (F.col("g") + (F.col("i") == F.col("j")).cast("double")).alias("scale"), (F.col("n") + q).alias("df"))


def sigma_vi(v: DataFrame) -> DataFrame:
    """(I + V'V) / (n - 1), the variational update for fixed V: i, j, sigma."""
    return gram(v).select("i", "j", ((F.col("g") + (F.col("i") == F.col("j")).cast("double")) / (F.col("n") - 1)).alias("sigma"))


def centered(w: DataFrame) -> DataFrame:
    """w (outcome, loc_id, w) less its mean by outcome, the mean being added up before it is shuffled: outcome, loc_id, w."""
    means = F.broadcast(w.groupBy("outcome").agg(F.avg("w").alias("mean")))  # a row for each outcome
    return w.join(means, "outcome").select("outcome", "loc_id", (F.col("w") - F.col("mean")).alias("w"))


def squares(residuals: DataFrame) -> DataFrame:
    """By outcome of residuals (outcome, e): n, sse, and sse about the mean; missing ones do not count."""
    return residuals.groupBy("outcome").agg(F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"), (F.var_samp("e") * (F.count("e") - 1)).alias("centered_sse"))


def noise_scale(residuals: DataFrame) -> DataFrame:
    """The inverse gamma step for the noise: outcome, shape 2 + n / 2, rate 1 + sse / 2, and the variational value."""
    s = squares(residuals)
    vi = (1 + F.col("centered_sse") / 2) / ((F.col("n") - 1) / 2 + 1)
    return s.select("outcome", (2 + F.col("n") / 2).alias("shape"), (1 + F.col("sse") / 2).alias("rate"), vi.alias("vi"))


def normal_equations(hx: DataFrame, hy: DataFrame) -> DataFrame:
    """Sums for least squares on whitened covariates hx (outcome, loc_id, p, v) and outcomes hy (outcome, loc_id, v).

    Rows a, b, i, j, xx = (H_a X)_i'(H_b X)_j, and xy = (H_a X)_i' H_b y, the latter repeated over j.
    """
    a = hx.select("loc_id", F.col("outcome").alias("a"), F.col("p").alias("i"), F.col("v").alias("u"))
    b = hx.select("loc_id", F.col("outcome").alias("b"), F.col("p").alias("j"), F.col("v").alias("w"))
    y = hy.select("loc_id", F.col("outcome").alias("b"), F.col("v").alias("y"))
    return a.join(b, "loc_id").join(y, ["loc_id", "b"]).groupBy("a", "b", "i", "j").agg(F.sum(F.col("u") * F.col("w")).alias("xx"), F.sum(F.col("u") * F.col("y")).alias("xy"))


def gaussian_loglik(residuals: DataFrame, noise: dict[int, float]) -> DataFrame:
    """Log likelihood of residuals (outcome, e) under independent noise, over all outcomes: one row, loglik."""
    d = F.create_map(*(F.lit(c) for j, v in noise.items() for c in (j, float(v))))[F.col("outcome")]
    one = -0.5 * (F.ln(2 * F.pi() * d) + F.col("e") * F.col("e") / d)
    return residuals.filter(F.col("e").isNotNull()).agg(F.sum(one).alias("loglik"))


def whitened_design(h: DataFrame, design: DataFrame) -> DataFrame:
    """H_a X for each outcome: outcome, loc_id, p, v."""
    x = design.select(F.col("loc_id").alias("j"), F.posexplode("x").alias("p", "u"))
    return h.join(x, "j").groupBy("outcome", F.col("i").alias("loc_id"), (F.col("p") + 1).alias("p")).agg(F.sum(F.col("v") * F.col("u")).alias("v"))

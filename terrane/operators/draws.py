"""Posterior draws (chain, iter, param, i, j, value): summaries, transformations and effective sample sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.neighbors import ranked


def thin(rows: DataFrame, most: int, key: str) -> DataFrame:
    """At most `most` rows evenly spaced in the order of key: positions round(seq(1, n, length)), halves to even."""
    n = rows.count()
    size = min(most, n)
    if not size:
        return rows.limit(0)
    step = (n - 1) / (size - 1) if size > 1 else 0.0
    keep = rows.sparkSession.range(size).select(F.bround(1 + F.col("id") * F.lit(step)).cast("long").alias("nth"))
    return ranked(rows, key).withColumn("nth", F.col("ord") + 1).join(F.broadcast(keep), "nth", "left_semi").drop("nth", "ord")  # `most` rows


def tail(draws: DataFrame, k: int) -> DataFrame:
    """The last k iterations of each chain."""
    last = F.broadcast(draws.groupBy("chain").agg(F.max("iter").alias("last")))
    return draws.join(last, "chain").filter(F.col("iter") > F.col("last") - k).drop("last")


def running_mean(draws: DataFrame, burn: int | None = None) -> DataFrame:
    """Running means by entry: chain, param, i, j, iter, mean. burn: weight 1 up to it, and k ** -0.65 for the k-th behind it; without it plain means."""
    w = Window.partitionBy("chain", "param", "i", "j").orderBy("iter")
    if burn is None:
        return draws.select("chain", "param", "i", "j", "iter", F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))
    # Behind the burn-in m_t = (1 - a_t) m_(t-1) + a_t x_t, so m_t / P_t is a running sum, P_t being the product of the 1 - a.
    steps = draws.select("chain", "param", "i", "j", "iter", "value", F.row_number().over(w).alias("t"))
    # The first behind the burn-in has weight 1 too: from there on the recursion runs.
    a = F.when(F.col("t") > burn + 1, F.pow((F.col("t") - burn).cast("double"), F.lit(-0.65)))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("a", a).withColumn("p", F.exp(F.coalesce(F.sum(F.ln(1 - F.col("a"))).over(before), F.lit(0.0))))
    first = F.coalesce(F.max(F.when(F.col("t") == burn + 1, F.col("value"))).over(Window.partitionBy("chain", "param", "i", "j")), F.lit(0.0))
    later = F.col("p") * (first + F.coalesce(F.sum(F.col("a") * F.col("value") / F.col("p")).over(before), F.lit(0.0)))
    return steps.select("chain", "param", "i", "j", "iter", F.when(F.col("t") <= burn + 1, F.col("value")).otherwise(later).alias("mean"))


def entry_covariance(draws: DataFrame) -> DataFrame:
    """Covariances over iterations of the entries of a parameter: chain, i, j, k, l, cov."""
    a = draws.select("chain", "iter", "i", "j", F.col("value").alias("a"))
    b = draws.select("chain", "iter", F.col("i").alias("k"), F.col("j").alias("l"), F.col("value").alias("b"))
    return a.join(b, ["chain", "iter"]).groupBy("chain", "i", "j", "k", "l").agg(F.covar_samp("a", "b").alias("cov"))


def gram_of_factor(draws: DataFrame) -> DataFrame:
    """S'S of each draw of S: chain, iter, i, j, value."""
    a = draws.select("chain", "iter", F.col("i").alias("k"), F.col("j").alias("i"), F.col("value").alias("a"))
    b = draws.select("chain", "iter", F.col("i").alias("k"), "j", F.col("value").alias("b"))
    return a.join(b, ["chain", "iter", "k"]).groupBy("chain", "iter", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def inverse_of_gram(draws: DataFrame) -> DataFrame:
    """(S'S)^-1 of each draw of S: chain, iter, i, j, value. A draw is a small matrix; draws are dealt to tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = int(max(pdf["i"].max(), pdf["j"].max()))
        s = np.zeros((q, q))
        s[pdf["i"] - 1, pdf["j"] - 1] = pdf["value"]
        inverse = np.linalg.inv(s)
        i, j = np.divmod(np.arange(q * q), q)
        return pd.DataFrame({"chain": pdf["chain"].iloc[0], "iter": pdf["iter"].iloc[0], "i": i + 1, "j": j + 1, "value": (inverse @ inverse.T).ravel()})

    return draws.groupBy("chain", "iter").applyInPandas(run, "chain int, iter int, i int, j int, value double")


def to_correlation(draws: DataFrame) -> DataFrame:
    """Correlations of each draw of a covariance: chain, iter, i, j, value."""
    d = draws.filter("i = j").select("chain", "iter", "i", F.col("value").alias("d"))
    out = draws.join(d.withColumnRenamed("d", "di"), ["chain", "iter", "i"]).join(d.select("chain", "iter", F.col("i").alias("j"), F.col("d").alias("dj")), ["chain", "iter", "j"])
    return out.select("chain", "iter", "i", "j", (F.col("value") / F.sqrt(F.col("di") * F.col("dj"))).alias("value"))


def identified(sigma: DataFrame, sigmasq: DataFrame) -> DataFrame:
    """Each draw of sigma times the outcomes' scales sqrt(sigmasq) on both sides; sigmasq: chain, iter, outcome, value."""
    s = sigmasq.select("chain", "iter", F.col("outcome").alias("i"), F.sqrt("value").alias("si"))
    t = s.select("chain", "iter", F.col("i").alias("j"), F.col("si").alias("sj"))
    out = sigma.join(s, ["chain", "iter", "i"]).join(t, ["chain", "iter", "j"])
    return out.select("chain", "iter", "i", "j", (F.col("value") * F.col("si") * F.col("sj")).alias("value"))


def effective_size(x: np.ndarray) -> float:
    """Of one series: autocorrelations by FFT, pairs summed while they are positive, made monotone."""
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return float(n)
    y = x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    rho = np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2, size)[:n]
    rho /= rho[0]
    half = n // 2
    pairs = rho[0 : 2 * half : 2] + rho[1 : 2 * half : 2]
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[: stop[0]] if len(stop) else pairs)
    return float(min(n, n / max(1.0, 2 * pairs.sum() - 1)))


def ess(draws: DataFrame) -> DataFrame:
    """Effective sample size of each entry: chain, param, i, j, n, ess. A task has the iterations of one entry."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("iter")["value"].to_numpy(float)
        return pd.DataFrame({"chain": [key[0]], "param": [key[1]], "i": [key[2]], "j": [key[3]], "n": [len(x)], "ess": [effective_size(x)]})

    kind = draws.schema["chain"].dataType.simpleString()
    return draws.groupBy("chain", "param", "i", "j").applyInPandas(run, f"chain {kind}, param string, i int, j int, n bigint, ess double")

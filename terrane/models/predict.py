"""Prediction at new places: each is independent of the others given the data, so they are dealt to tasks as they come."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.kernels import MATERN, Theta
from terrane.operators import neighbors, vecchia


class Draw(NamedTuple):
    """One posterior draw: beta (p, q), sigma (q, q), a theta for each outcome, and noise (q) in the latent model."""

    beta: np.ndarray
    sigma: np.ndarray
    thetas: tuple[Theta, ...]
    noise: np.ndarray | None = None


def _near(train: DataFrame, new: DataFrame, m: int) -> DataFrame:
    """New places with their nearest training places: node, x, y, parents, px, py."""
    places = train.select(F.col("loc_id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    edges = neighbors.knn(train, new, m).join(places, "parent")
    of = edges.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "parent", "px", "py"))).alias("p"))
    return new.select(F.col("loc_id").alias("node"), "x", "y").join(of, "node").select("node", "x", "y", F.col("p.parent").alias("parents"), F.col("p.px").alias("px"), F.col("p.py").alias("py"))


def weights(train: DataFrame, new: DataFrame, thetas: Sequence[Theta], m: int, family: int = MATERN) -> DataFrame:
    """Kriging weights and conditional standard deviations by outcome: outcome, node, parents, h, sd."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["parents"].map(len).to_numpy()
            for k in np.unique(size):
                part = pdf[size == k]
                theirs = np.stack([np.stack(part["px"]), np.stack(part["py"])], axis=-1)
                for j, theta in enumerate(thetas, 1):
                    h, r2 = vecchia.solve(part[["x", "y"]].to_numpy(float), theirs, theta, family)
                    yield pd.DataFrame({"outcome": j, "node": part["node"].to_numpy(), "parents": list(part["parents"]), "h": list(h), "sd": np.sqrt(np.abs(r2))})

    return _near(train, new, m).mapInPandas(run, "outcome int, node bigint, parents array<bigint>, h array<double>, sd double")


def mean(train: DataFrame, new: DataFrame, values: DataFrame, fixed: DataFrame, thetas: Sequence[Theta], m: int, family: int = MATERN) -> DataFrame:
    """x beta plus kriged values: loc_id, outcome, mean, sd. values (loc_id, outcome, a) at training places, all of them or it fails; fixed (loc_id, outcome, f) at new ones."""
    w = weights(train, new, thetas, m, family)
    each = w.select("outcome", "node", "sd", F.explode(F.arrays_zip("parents", "h")).alias("e")).select("outcome", "node", "sd", F.col("e.parents").alias("loc_id"), "e.h")
    gap = F.raise_error(F.lit("a neighbour has no value: missing outcomes are to be imputed first")).cast("double")
    each = each.join(values.select("outcome", "loc_id", F.coalesce("a", gap).alias("a"), F.lit(True).alias("there")), ["outcome", "loc_id"], "left").withColumn("a", F.when(F.col("there"), F.col("a")).otherwise(gap))
    sums = each.groupBy("outcome", "node").agg(F.sum(F.col("h") * F.col("a")).alias("k"), F.first("sd").alias("sd"))
    return sums.join(fixed.select(F.col("loc_id").alias("node"), "outcome", "f"), ["outcome", "node"]).select(F.col("node").alias("loc_id"), "outcome", (F.col("f") + F.col("k")).alias("mean"), "sd")


def _gathered(train: DataFrame, new: DataFrame, design_new: DataFrame, m: int, values: DataFrame) -> DataFrame:
    """New places with their covariates and, for each neighbour in order, the array `values` (loc_id, a)."""
    near = _near(train, new, m)
    each = near.select("node", F.posexplode("parents").alias("k", "loc_id")).join(values, "loc_id")
    got = each.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda s: s["a"]).alias("theirs"))
    return near.join(got, "node").join(design_new.select(F.col("loc_id").alias("node"), F.col("x").alias("xs")), "node")


OUT = "loc_id bigint, draw int, outcome int, value double"
#: Numbers that a task holds for a batch of places, about: places times draws times neighbours times outcomes.
CELLS = 2_000_000


def _parts(batches: Iterator[pd.DataFrame], per_neighbour: int) -> Iterator[pd.DataFrame]:
    """Places with the same number of neighbours, few enough at a time."""
    for pdf in batches:
        size = pdf["parents"].map(len).to_numpy()
        for k in np.unique(size):
            part = pdf[size == k]
            step = max(1, CELLS // (per_neighbour * int(k)))
            for at in range(0, len(part), step):
                yield part.iloc[at : at + step]


def _kriging(part: pd.DataFrame, draws: Sequence[Draw], family: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each distinct thetas: the numbers of their draws, weights (q, n, k), conditional standard deviations (n, q)."""
    at, parents = part[["x", "y"]].to_numpy(float), np.stack([np.stack(part["px"]), np.stack(part["py"])], axis=-1)
    alike: dict[tuple[Theta, ...], list[int]] = {}
    for d, draw in enumerate(draws):
        alike.setdefault(tuple(draw.thetas), []).append(d)
    for thetas, which in alike.items():
        solved = [vecchia.solve(at, parents, t, family) for t in thetas]
        yield np.array(which), np.stack([h for h, _ in solved]), np.sqrt(np.abs(np.stack([r for _, r in solved], axis=1)))


def _normals(nodes: np.ndarray, seed: int, shape: tuple[int, int]) -> np.ndarray:
    """Standard normals keyed by seed and place, so that they don't depend on partitions."""
    return np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i) & (2**64 - 1)])).standard_normal(shape) for i in nodes])


def _given(known: dict[int, float], centre: np.ndarray, sd: np.ndarray, sigma: np.ndarray, z: np.ndarray | None) -> np.ndarray:
    """Outcomes of one place for draws (d, q), conditional on those that are known there, which are given back."""
    q = centre.shape[1]
    have, gone = sorted(known), [j for j in range(q) if j not in known]
    value, cov = centre.copy(), sigma * np.outer(sd, sd)
    value[:, have] = [known[j] for j in have]
    cross = cov[:, gone][:, :, have]
    # A known outcome at a training place has no variance left and says nothing more.
    solved = cross @ np.linalg.pinv(cov[:, have][:, :, have])
    value[:, gone] += (solved @ (value[:, have] - centre[:, have])[:, :, None])[:, :, 0]
    if z is not None and gone:
        left = cov[:, gone][:, :, gone] - solved @ cross.transpose(0, 2, 1)
        lam, vec = np.linalg.eigh((left + left.transpose(0, 2, 1)) / 2)
        value[:, gone] += (vec @ (np.sqrt(np.maximum(lam, 0)) * z[:, : len(gone)])[:, :, None])[:, :, 0]
    return value


def _rows(part: pd.DataFrame, value: np.ndarray) -> pd.DataFrame:
    n, total, q = value.shape
    return pd.DataFrame({"loc_id": np.repeat(part["node"].to_numpy(), total * q), "draw": np.tile(np.repeat(np.arange(1, total + 1), q), n), "outcome": np.tile(np.arange(1, q + 1), n * total), "value": value.ravel()})


def response(
    train: DataFrame, obs: DataFrame, design: DataFrame, new: DataFrame, design_new: DataFrame, draws: Sequence[Draw], m: int = 15, family: int = MATERN, seed: int = 1,
    partly: DataFrame | None = None, noise: bool = True, imputed: DataFrame | None = None,
) -> DataFrame:
    """Posterior predictions of the response model: loc_id, draw (from 1), outcome, value.

    Outcomes missing in obs at training places must be in imputed (loc_id, draw, outcome, value), else they are refused. partly
    (loc_id, outcome, y) holds outcomes known at new places: they are given back, and the others are conditional
    on them. noise=False gives conditional means. Random numbers are keyed by seed and place.
    """
    gap = obs.join(train.select("loc_id"), "loc_id", "left_semi").filter(F.col("y").isNull() | F.isnan("y"))
    if not (gap if imputed is None else gap.join(imputed, ["loc_id", "outcome"], "left_anti")).isEmpty():
        raise ValueError("outcomes are missing at training places: give draws of them")
    q, total, drawn_too, known_too = len(draws[0].thetas), len(draws), imputed is not None, partly is not None
    one = F.struct("outcome", F.coalesce("y", F.lit(float("nan"))).alias("y"))
    values = obs.groupBy("loc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda o: o["y"]).alias("ys")).join(design, "loc_id")
    if imputed is None:
        values = values.withColumn("drawn", F.array().cast("array<double>"))
    else:  # all draws of a place's missing outcomes, in order of draw and outcome
        drawn = imputed.groupBy("loc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "outcome", "value"))), lambda o: o["value"]).alias("drawn"))
        values = values.join(drawn, "loc_id", "left").withColumn("drawn", F.coalesce("drawn", F.array().cast("array<double>")))
    rows = _gathered(train, new, design_new, m, values.select("loc_id", F.struct(F.concat("ys", "x").alias("a"), "drawn").alias("a")))
    if partly is not None:
        known = partly.groupBy("loc_id").agg(F.collect_list(F.struct("outcome", "y")).alias("known"))
        rows = rows.join(known.withColumnRenamed("loc_id", "node"), "node", "left")

    def outcomes_of(theirs: list) -> tuple[np.ndarray, np.ndarray]:
        """Outcomes (n, k, draws or 1, q) and covariates (n, k, p) of neighbours."""
        a = np.stack([np.stack([o["a"] for o in t]) for t in theirs]).astype(float)
        ys = a[:, :, None, :q]
        if drawn_too:
            ys = np.repeat(ys, total, axis=2)
            for i, t in enumerate(theirs):
                for k, o in enumerate(t):
                    if len(o["drawn"]):
                        gone = np.isnan(ys[i, k, 0])
                        ys[i, k][:, gone] = np.asarray(o["drawn"], float).reshape(total, -1)
        return ys, a[:, :, q:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        betas, sigmas = np.stack([d.beta for d in draws]), np.stack([d.sigma for d in draws])
        for part in _parts(batches, total * q):
            ys, theirs_x = outcomes_of(list(part["theirs"]))
            xs, nodes = np.stack(part["xs"]).astype(float), part["node"].to_numpy()
            z = _normals(nodes, seed, (total, q)) if noise else None
            value = np.empty((len(part), total, q))
            for which, h, sd in _kriging(part, draws, family):
                e = (ys[:, :, which] if drawn_too else ys) - np.einsum("nkp,dpq->nkdq", theirs_x, betas[which])
                centre = np.einsum("np,dpq->ndq", xs, betas[which]) + np.einsum("qnk,nkdq->ndq", h, e)
                value[:, which] = centre
                if noise:
                    value[:, which] += np.einsum("dij,ndj->ndi", np.linalg.cholesky(sigmas[which]), z[:, which]) * sd[:, None, :]
                for i, told in enumerate(part["known"] if known_too else ()):
                    known = {int(o["outcome"]) - 1: float(o["y"]) for o in (told if told is not None else ()) if o["y"] is not None and np.isfinite(o["y"])}
                    if known:
                        value[i, which] = _given(known, centre[i], sd[i], sigmas[which], z[i, which] if noise else None)
            yield _rows(part, value)

    return rows.mapInPandas(run, OUT)


def latent(train: DataFrame, w: DataFrame, new: DataFrame, design_new: DataFrame, draws: Sequence[Draw], m: int = 15, family: int = MATERN, seed: int = 1, noise: bool = True) -> DataFrame:
    """Posterior predictions of the latent model from draws of the process w (loc_id, draw, outcome, w): loc_id, draw, outcome, value.

    Each new place gathers the process at its neighbours, for all draws; nothing else of w is moved.
    """
    q, total = len(draws[0].thetas), len(draws)
    values = w.groupBy("loc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "outcome", "w"))), lambda o: o["w"]).alias("a"))
    rows = _gathered(train, new, design_new, m, values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        betas, sigmas = np.stack([d.beta for d in draws]), np.stack([d.sigma for d in draws])
        spread = np.sqrt(np.stack([np.zeros(q) if d.noise is None else d.noise for d in draws]))
        for part in _parts(batches, total * q):
            process = np.stack([np.stack(t) for t in part["theirs"]]).astype(float).reshape(len(part), -1, total, q)
            xs, value = np.stack(part["xs"]).astype(float), np.empty((len(part), total, q))
            z = _normals(part["node"].to_numpy(), seed, (total, 2 * q)) if noise else None
            for which, h, sd in _kriging(part, draws, family):
                value[:, which] = np.einsum("np,dpq->ndq", xs, betas[which]) + np.einsum("qnk,nkdq->ndq", h, process[:, :, which])
                if noise:
                    own = np.einsum("dij,ndj->ndi", np.linalg.cholesky(sigmas[which]), z[:, which, :q])
                    value[:, which] += own * sd[:, None, :] + spread[which] * z[:, which, q:]
            yield _rows(part, value)

    return rows.mapInPandas(run, OUT)

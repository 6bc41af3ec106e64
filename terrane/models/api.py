"""Entry points: fit, simulate, starting values, prediction.

A chain is one task, with the data of its model, or a stage of tasks that hold a tile of the places each; chains are stored as they
run (chains.py, tiles.py). What scales with the data and not with iterations (neighbours, moments of the variational response fit, kriging weights, prediction) is left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.kernels import MATERN, Theta
from terrane.models import predict as predictions
from terrane.models import chains as streams
from terrane.models import sampler, starting, tiles as tiled
from terrane.models.linalg import Graph
from terrane.operators import moments, neighbors, vecchia
from terrane.sources import storage, tables

#: Locations up to which the data of a chain, or of a variational latent fit, go to one task by default.
ONE_TASK = 20_000
DRAWS = tables.DRAWS


@dataclass
class Fit:
    """Draws or estimates (chain, iter, param, i, j, value).

    W and Y are by place: i is the place's rank counted from 1, that is ord + 1 in `places` (loc_id, ord), and j the outcome. Y
    has a row for each missing outcome of a place; see imputed().
    """

    draws: DataFrame
    edges: DataFrame
    places: DataFrame
    info: dict = field(default_factory=dict)


def model_rows(locs: DataFrame, obs: DataFrame, design: DataFrame, order: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a location: ord, x, y, its outcomes by number (nan if missing), covariates, and parents by ord."""
    ys = obs.groupBy("loc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("outcome", F.coalesce("y", F.lit(float("nan"))).alias("y")))), lambda o: o["y"]).alias("ys"))
    ps = edges.select(F.col("node").alias("loc_id"), "k", F.col("parent").alias("p")).join(order.select(F.col("loc_id").alias("p"), F.col("ord").alias("po")), "p")
    ps = ps.groupBy("loc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "po"))), lambda o: o["po"]).alias("parents"))
    rows = locs.join(order.select("loc_id", "ord"), "loc_id").join(ys, "loc_id").join(design.withColumnRenamed("x", "xs"), "loc_id").join(ps, "loc_id", "left")
    return rows.withColumn("parents", F.coalesce("parents", F.array().cast("array<bigint>")))


def unpack(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, Graph]:
    pdf = pdf.sort_values("ord").reset_index(drop=True)
    y, x = np.stack(pdf["ys"]).astype(float), np.stack(pdf["xs"]).astype(float)
    return pdf, y, x, Graph(pdf[["x", "y"]].to_numpy(float), [np.asarray(p, int) for p in pdf["parents"]])


def long(chain: int, draws: dict[str, np.ndarray]) -> pd.DataFrame:
    """Arrays (iter, i, j) or (i, j) as rows, all counted from 1; iter is 0 for estimates."""
    out = []
    for param, a in draws.items():
        a = np.asarray(a, float)
        single = a.ndim == 2
        a = a[None] if single else a if a.ndim == 3 else a.reshape(len(a), -1, 1)
        it, i, j = (x.ravel() for x in np.indices(a.shape))
        out.append(pd.DataFrame({"chain": chain, "iter": it + (0 if single else 1), "param": param, "i": i + 1, "j": j + 1, "value": a.ravel()}))
    return pd.concat(out) if out else pd.DataFrame(columns=["chain", "iter", "param", "i", "j", "value"])


def ordered(locations: DataFrame, order: str) -> DataFrame:
    """loc_id and ord: by id, by rows of a grid, in max-min order, or by levels of cells, which is near it."""
    if order == "grid":
        rows = neighbors.grid_steps(locations).select("loc_id", F.struct("gy", "gx").alias("key"))
        return neighbors.ranked(rows, "key").select("loc_id", "ord")
    if order == "levels":
        return neighbors.level_order(locations)
    if order != "maxmin":
        return neighbors.ranked(locations).select("loc_id", "ord")
    return neighbors.max_min(locations)


def cells(chain: int, values: np.ndarray, missing: np.ndarray) -> pd.DataFrame:
    """Draws (iter, cell, 1) of the cells (place, outcome) that are missing."""
    at, outcome = np.nonzero(missing)
    n = len(values)
    return pd.DataFrame({"chain": chain, "iter": np.repeat(np.arange(1, n + 1), len(at)), "param": "Y", "i": np.tile(at + 1, n), "j": np.tile(outcome + 1, n), "value": values.reshape(-1)})


def fit(
    locations: DataFrame, observations: DataFrame, design: DataFrame, *, m: int = 15, model: str = "response", method: str = "mcmc", iters: int = 1000, chains: int = 1,
    start: str | dict = "auto", family: int = MATERN, nu: float | None = 0.5, order: str = "auto", seed: int = 1, update_theta: tuple[bool, bool, bool] | None = None,
    sampler_name: str = sampler.BLOCK, preconditioner: str = "auto", sample: tuple[bool, bool, bool] = (True, True, True), tol: float | None = None, complete: bool | None = None, predictive: int = 0, timings: bool = False, store: str | None = None, segment: int = streams.SEGMENT, thin: int = 1, keep_process: bool = True, tiles: int | None = None,
) -> Fit:
    """Fits a model of several outcomes at many places.

    model: response (outcomes are the process) or latent (process plus noise). method: mcmc or vi. start: auto, or a dict with beta, sigma,
    thetas, noise, w (all or some). update_theta: whether phi, nu and the nugget's share are sampled; by default phi and the share in
    the response model and none in the latent one. complete: only places with all outcomes; by default for vi of the
    response model, for others missing outcomes are imputed. order: maxmin, levels (near it, by many tasks), id, or grid, which
    refuses places that are not all of a grid; auto is grid where they are, and else maxmin. store: the folder in which draws are kept, a new one in the shared folder by default; chains run now, and once. A
    chain is stored in segments of so many sweeps: with the folder of a run that was broken off, or had fewer iters, it goes on from
    there. tiles: the tasks of a chain or a variational latent fit, which hold a tile of the places each; by default one up to 20,000 places or where a start has w, and beyond so many that tiles have
    10,000, but no more than there are cores (one chain then runs after the other, and as many cores must be free). thin: each thin-th sweep is kept. keep_process: whether draws of W are. timings: draws get a param Seconds, what each phase of all sweeps took, i being its number in info["phases"]. Tables with
    faults are refused.
    """
    if model not in ("response", "latent") or method not in ("mcmc", "vi"):
        raise ValueError(f"no fit {model}:{method}")
    tables.check(locations, observations, design)
    latent = model == "latent"
    given = locations.count()
    if complete if complete is not None else not latent and method == "vi":
        observations = moments.complete_cases(observations)
        locations = locations.join(observations.select("loc_id").distinct(), "loc_id", "left_semi")
    locations = storage.once(locations, "locations")
    n = locations.count()
    if (latent or method == "mcmc") and n > ONE_TASK and not (tiles or "w" in start):
        tiles = max(1, min(-(-n // tiled.TILE_ROWS), locations.sparkSession.sparkContext.defaultParallelism))  # all tiles run at once
    if order == "auto":
        order = "grid" if neighbors.grid_check(locations).first()["gridded"] else "maxmin"
    ranks = storage.once(ordered(locations, order), "ranks")
    by_ord = locations.join(ranks, "loc_id").select(F.col("ord").alias("loc_id"), "x", "y")
    named = neighbors.vecchia_dag(by_ord, m, "grid").drop("dx", "dy") if order == "grid" else neighbors.ordered_knn(by_ord, m)
    node, parent = ranks.select(F.col("ord").alias("node"), F.col("loc_id").alias("n")), ranks.select(F.col("ord").alias("parent"), F.col("loc_id").alias("p"))
    edges = storage.once(named.join(node, "node").join(parent, "parent").select(F.col("n").alias("node"), F.col("p").alias("parent"), "k", "d"), "edges")
    info = {"model": model, "method": method, "m": m, "family": family, "order": order, "dropped": given - n, "phases": sampler.phases(latent, sampler_name)}
    start = {} if start == "auto" else dict(start)
    if not ({"sigma", "thetas"} | (set() if method == "vi" and not latent else {"beta"})) <= start.keys():
        start = auto_start(locations, observations, design, edges, ranks, m=m, latent=latent, nu=nu, family=family) | start
    if method == "vi" and not latent:
        return Fit(_response_vi(locations, observations, design, edges, start, family, tol or 1e-5), edges, ranks, info)
    free = update_theta if update_theta is not None else (False, False, False) if latent else (True, False, True)
    if latent:
        free = (free[0], free[1], False)  # the nugget is the noise
    options = dict(latent=latent, family=family, update=(free[0], False, free[1], free[2]), sampler=sampler_name, preconditioner=preconditioner, sample_beta=sample[0], sample_sigma=sample[1], sample_noise=sample[2])
    rows = model_rows(locations, observations, design, ranks, edges)
    folder = store or storage.new_folder(locations.sparkSession, "fit")
    if method == "mcmc":
        make = lambda y, x, graph, rng: make_state(y, x, graph, start, options, rng)
        if tiles and tiles > 1:
            dealt, own, means = _tiled(rows, locations, observations, edges, ranks, tiles, folder, start, options)
            settings = {"m": m, "order": order, "start": own, "options": options}
            return Fit(tiled.run(dealt, tiles, chains, iters, folder, own, means, options, seed, settings, segment, thin, keep_process, timings), edges, ranks, info | {"store": folder, "tiles": tiles})
        settings = {"options": options, "start": start, "m": m, "order": order}
        draws = streams.run(rows, chains, iters, folder, make, seed, settings, segment, thin, keep_process, timings)
        return Fit(draws, edges, ranks, info | {"store": folder})
    if tiles and tiles > 1:
        dealt, own, means = _tiled(rows, locations, observations, edges, ranks, tiles, folder, start, options)
        return Fit(tiled.run_vi(dealt, tiles, chains, folder, own, means, options, seed, tol or 1e-2, predictive, long), edges, ranks, info | {"store": folder, "tiles": tiles})
    dealt = rows.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(chains))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.Generator(np.random.Philox(key=[seed, int(key[0])]))
        _, y, x, graph = unpack(pdf)
        state = make_state(y, x, graph, start, options, rng)
        got = sampler.estimates(state, rng, tol or 1e-2, predictive)
        drawn = got.pop("Y", None)
        out = long(int(key[0]), got)
        return out if drawn is None or not drawn.size else pd.concat([out, cells(int(key[0]), drawn, ~state.there)])

    return Fit(storage.kept(dealt.groupBy("chain").applyInPandas(run, DRAWS), f"{folder}/draws"), edges, ranks, info | {"store": folder})


def _tiled(rows: DataFrame, locs: DataFrame, obs: DataFrame, edges: DataFrame, ranks: DataFrame, tiles: int, folder: str, start: dict, options: dict) -> tuple[DataFrame, dict, list[float]]:
    """Rows by tile, the start, and where the process starts at places without an outcome. Colours are made only for what goes by them."""
    own = dict(start)
    if "w" in own:
        raise ValueError("a start of the process is by place; chains over tiles take none")
    own = {"noise": np.ones(len(own["thetas"]))} | own
    told = obs.groupBy("outcome").agg(F.avg("y").alias("mean"), F.count_if(F.col("y").isNull()).alias("gone")).orderBy("outcome").collect()  # a row an outcome
    by_color = options["sampler"] == sampler.SITE if options["latent"] else any(r["gone"] for r in told)
    colors = storage.kept(neighbors.coloring(neighbors.blanket(edges)), f"{folder}/colors") if by_color else None
    return tiled.tile_rows(rows, ranks, locs, edges, colors, tiles), own, [r["mean"] or 0.0 for r in told]


def make_state(y: np.ndarray, x: np.ndarray, graph: Graph, start: dict, options: dict, rng: np.random.Generator) -> sampler.State:
    """A chain's first state. start: beta, sigma, thetas; noise and w if they are not to be 1 and the outcomes' own."""
    v = {"noise": np.ones(y.shape[1]), "w": None} | start
    if v["w"] is None:
        v["w"] = np.where(np.isfinite(y), y, np.nanmean(y, 0)) - x @ v["beta"]
    return sampler.State(y, x, graph, [Theta(*t) for t in v["thetas"]], np.array(v["beta"], float), np.array(v["sigma"], float), np.array(v["noise"], float), sampler.Options(**options), np.array(v["w"], float))


def vi_moments(locations: DataFrame, observations: DataFrame, design: DataFrame, edges: DataFrame, thetas: Sequence[Theta], family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Whitened moments xx, xy, yy and the number of places.

    Values of a node's parents are gathered once, for all outcomes; a batch of nodes is whitened and multiplied where it is, and only
    its (q (p + 1)) ** 2 sums move on.
    """
    ys = observations.groupBy("loc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("outcome", "y"))), lambda o: o["y"]).alias("ys"))
    rows = locations.select(F.col("loc_id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py")).join(design.select(F.col("loc_id").alias("parent"), F.col("x").alias("xs")), "parent")
    rows = rows.join(ys.withColumnRenamed("loc_id", "parent"), "parent").select("parent", F.struct("px", "py", F.concat("xs", "ys").alias("u")).alias("v"))
    every = edges.select("node", "k", "parent").unionByName(rows.select(F.col("parent").alias("node"), F.lit(0).alias("k"), "parent"))
    met = every.join(rows, "parent").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("f"))
    q = len(thetas)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = None, 0
        for pdf in batches:
            for size, part in pdf.groupby(pdf["px"].map(len)):
                for at in range(0, len(part), 4096):
                    own = part.iloc[at : at + 4096]
                    places = np.stack([np.stack(own["px"]), np.stack(own["py"])], axis=-1)
                    u = np.array([np.stack(x) for x in own["u"]], float).reshape(len(own), size, -1)
                    p = u.shape[2] - q
                    white = []
                    for j, theta in enumerate(thetas):
                        h, r2 = vecchia.solve(places[:, 0], places[:, 1:], theta, family)
                        z = u[:, :, [*range(p), p + j]]
                        white.append((z[:, 0] - np.einsum("nk,nkc->nc", h, z[:, 1:])) / np.sqrt(r2)[:, None])
                    w = np.concatenate(white, 1)
                    sums = w.T @ w if sums is None else sums + w.T @ w
                    n += len(own)
        if sums is not None:
            yield pd.DataFrame({"s": [[float(n), *sums.ravel().tolist()]]})

    each = met.select(F.col("f.v.px").alias("px"), F.col("f.v.py").alias("py"), F.col("f.v.u").alias("u")).mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    got = np.array([r["v"] for r in each.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])  # 1 + (q (p + 1))^2 numbers
    width = round((len(got) - 1) ** 0.5) // q
    s = got[1:].reshape(q, width, q, width).transpose(0, 2, 1, 3)
    return s[:, :, :-1, :-1].copy(), s[:, :, :-1, -1].copy(), s[:, :, -1, -1].copy(), int(got[0])


def _response_vi(locs: DataFrame, obs: DataFrame, design: DataFrame, edges: DataFrame, own: dict, family: int, tol: float) -> DataFrame:
    got = sampler.response_vi(*vi_moments(locs, obs, design, edges, [Theta(*t) for t in own["thetas"]], family), np.array(own["sigma"], float), tol)
    got["Theta"] = np.array([Theta(*t) for t in own["thetas"]]).T
    return locs.sparkSession.createDataFrame(long(1, got), DRAWS)


def imputed(fit_: Fit) -> DataFrame:
    """Draws of the missing outcomes: chain, iter, loc_id, outcome, value."""
    y = fit_.draws.filter("param = 'Y'")
    return y.join(fit_.places, y["i"] == fit_.places["ord"] + 1).select("chain", "iter", "loc_id", F.col("j").alias("outcome"), "value")


def predict(
    fit_: Fit, locations: DataFrame, observations: DataFrame, design: DataFrame, new: DataFrame, design_new: DataFrame, *, burn: int = 0, every: int = 1, partly: DataFrame | None = None, seed: int = 1, noise: bool = True,
) -> DataFrame:
    """Posterior predictions at new places from what fit() returned: loc_id, draw, outcome, value.

    Draws are those behind `burn`, each `every`-th, of all chains, numbered from 1 by chain and iteration; a variational fit is one
    draw, its estimate. Their parameters, (p + q + 5) q numbers a draw, reach the driver; what is by place stays where it
    is. Outcomes that were missing are taken from each draw. partly: outcomes known at new places (response model).
    """
    latent = fit_.info["model"] == "latent"
    chosen = fit_.draws.filter((F.col("iter") == 0) | ((F.col("iter") > burn) & ((F.col("iter") - burn - 1) % every == 0)))
    small = chosen.filter(F.col("param").isin("Beta", "Sigma", "Theta", "Ddiag")).toPandas()
    if small.empty:
        raise ValueError("no draws are left")

    def table(part: pd.DataFrame, param: str) -> np.ndarray:
        return part[part["param"] == param].pivot(index="i", columns="j", values="value").to_numpy()

    draws, numbers = [], []
    for d, ((chain, it), part) in enumerate(small.groupby(["chain", "iter"], sort=True), 1):
        noise_ = table(part, "Ddiag").ravel() if latent else None
        draws.append(predictions.Draw(table(part, "Beta"), table(part, "Sigma"), tuple(Theta(*map(float, t)) for t in table(part, "Theta").T), noise_))
        numbers.append((int(chain), int(it), d))
    numbered = F.broadcast(fit_.draws.sparkSession.createDataFrame(numbers, "chain int, iter int, draw int"))
    m, family = fit_.info["m"], fit_.info["family"]
    if latent:
        w = chosen.filter("param = 'W'").join(numbered, ["chain", "iter"])
        w = w.join(fit_.places, w["i"] == fit_.places["ord"] + 1).select("loc_id", "draw", F.col("j").alias("outcome"), F.col("value").alias("w"))
        return predictions.latent(locations, w, new, design_new, draws, m, family, seed, noise)
    # Places that the fit left out, being incomplete, take no part.
    train = locations.join(fit_.places.select("loc_id"), "loc_id", "left_semi")
    obs = observations.join(fit_.places.select("loc_id"), "loc_id", "left_semi")
    gaps = obs.filter(F.col("y").isNull() | F.isnan("y")).isEmpty()
    drawn = None if gaps else imputed(fit_).join(numbered, ["chain", "iter"]).select("loc_id", "draw", "outcome", "value")
    return predictions.response(train, obs, design, new, design_new, draws, m, family, seed, partly, noise, drawn)


def auto_start(locs: DataFrame, obs: DataFrame, design: DataFrame, edges: DataFrame, ranks: DataFrame, *, m: int = 15, latent: bool = False, nu: float | None = 0.5, family: int = MATERN) -> dict:
    """Starting values by a univariate fit of each outcome, outcomes side by side: beta, sigma, thetas, noise.

    An outcome's fit is over the places where it is observed; where some are missing, these have a graph of their own, with m parents.
    """
    told = obs.groupBy("outcome").agg(F.count_if(F.col("y").isNull() | F.isnan("y")).alias("gone")).orderBy("outcome").collect()  # a row an outcome
    seen = obs.filter(F.col("y").isNotNull() & ~F.isnan("y"))
    by_ord, parts = locs.join(ranks.select("loc_id", "ord"), "loc_id"), []
    for r in told:
        own = edges.select("node", "parent", "k")
        if r["gone"]:
            some = by_ord.join(seen.filter(F.col("outcome") == r["outcome"]).select("loc_id"), "loc_id", "left_semi")
            found = neighbors.ordered_knn(some.select(F.col("ord").alias("loc_id"), "x", "y"), m)
            node, parent = ranks.select(F.col("ord").alias("node"), F.col("loc_id").alias("n")), ranks.select(F.col("ord").alias("parent"), F.col("loc_id").alias("p"))
            own = found.join(node, "node").join(parent, "parent").select(F.col("n").alias("node"), F.col("p").alias("parent"), "k")
        parts.append(own.withColumn("outcome", F.lit(r["outcome"])))
    rows = storage.once(starting.families(locs, seen, design, reduce(DataFrame.unionByName, parts)), "families")
    found = starting.fit(rows, [r["outcome"] for r in told], nu, family)
    return starting.starting_values([found[r["outcome"]][0] for r in told], latent)


def simulate(locations: DataFrame, sigma: np.ndarray, thetas: Sequence[Theta], *, m: int = 15, family: int = MATERN, order: str = "maxmin", seed: int = 1, demean: bool = True) -> DataFrame:
    """Draws outcomes at places: loc_id, outcome, y. White noise is keyed by seed and rank, so results don't depend on partitions."""
    sigma = np.asarray(sigma, float)
    if sigma.shape != (len(thetas),) * 2 or not np.allclose(sigma, sigma.T) or (np.linalg.eigvalsh(sigma) <= 0).any():
        raise ValueError("sigma must be a covariance matrix with a row for each outcome")
    ranks = storage.once(ordered(locations, order), "ranks")
    by_ord = locations.join(ranks, "loc_id").select(F.col("ord").alias("loc_id"), "x", "y")
    f = vecchia.factors(by_ord, neighbors.ordered_knn(by_ord, m), thetas, family)
    chol = np.linalg.cholesky(sigma)
    q = len(thetas)

    def white(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u = np.array([np.random.Generator(np.random.Philox(key=[seed, int(o)])).standard_normal(q) for o in pdf["loc_id"]]).reshape(-1, q)
            v = u @ chol.T
            yield pd.DataFrame({"outcome": np.tile(np.arange(1, q + 1), len(pdf)), "loc_id": np.repeat(pdf["loc_id"].to_numpy(), q), "a": v.ravel()})

    noise = by_ord.select("loc_id").mapInPandas(white, "outcome int, loc_id bigint, a double")
    w = vecchia.inverse_times(f, noise).select("outcome", "loc_id", F.col("v").alias("w"))
    if demean:
        w = moments.centered(w)
    return w.join(ranks.withColumnRenamed("loc_id", "id"), w["loc_id"] == ranks["ord"]).select(F.col("id").alias("loc_id"), "outcome", F.col("w").alias("y"))

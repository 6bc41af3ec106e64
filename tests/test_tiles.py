"""Chains over tiles of places, in a stage of tasks that run at once."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.models import api, chains, sampler, tiles
from terrane.operators import neighbors
from test_models import frames, simulated, small_tables


def means(fit, param, burn):
    pdf = fit.draws.filter((F.col("param") == param) & (F.col("iter") > burn)).toPandas()
    return pdf.pivot_table(index="i", columns="j", values="value").to_numpy()


def test_tiles_are_even(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.random((900, 2)), 0.01 * rng.random((2100, 2))])
    points = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(3000), "x": xy[:, 0], "y": xy[:, 1]}))
    for n in (1, 2, 5, 9):
        sizes = [r["count"] for r in tiles.deal(points, n).groupBy("tile").count().collect()]
        assert len(sizes) == n and max(sizes) - min(sizes) < 0.1 * 3000 / n + 3


def test_colours_by_rounds_are_those_of_one_pass(spark):
    rng = np.random.default_rng(2)
    locs = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(500), "x": rng.random(500), "y": rng.random(500)}))
    blankets = neighbors.blanket(neighbors.ordered_knn(locs, 6)).persist()
    want = neighbors.greedy_colors({r["node"]: r["members"] for r in blankets.collect()})
    for tasks in (1, 4):
        assert {r["node"]: r["color"] for r in neighbors.coloring(blankets, tasks).collect()} == want
    assert neighbors.coloring(blankets.limit(0)).collect() == []



@pytest.mark.parametrize("sampler_name", [sampler.BLOCK, sampler.SITE, sampler.OUTCOME])
def test_latent_chains_over_tiles_have_the_law_of_one_task(spark, sampler_name):
    xy, y, sigma, thetas = simulated(220, 2, 0.5, 0.3, 21, gone=0.03)
    keep = np.isfinite(y).any(1)
    xy, y = xy[keep], y[keep]
    start = {"beta": np.zeros((1, 2)), "sigma": np.eye(2), "thetas": [tuple(t) for t in thetas], "noise": np.full(2, 0.09)}
    options = dict(m=8, iters=90, model="latent", start=start, sampler_name=sampler_name, order="id")
    one, many = api.fit(*frames(spark, xy, y), **options, preconditioner="jacobi"), api.fit(*frames(spark, xy, y), **options, tiles=3)
    assert many.info["tiles"] == 3 and many.draws.filter("param = 'W'").count() == 90 * 2 * len(y)
    a, b = means(one, "W", 40), means(many, "W", 40)
    assert np.sqrt(((a - b) ** 2).mean()) < 0.15 and np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.97
    assert np.abs(means(one, "Ddiag", 40) - means(many, "Ddiag", 40)).max() < 0.05
    assert np.abs(means(one, "Sigma", 40) - means(many, "Sigma", 40)).max() < 0.5


def test_response_chains_over_tiles(spark):
    xy, y, _, _ = simulated(200, 2, 0.5, 0.1, 22, gone=0.05)
    keep = np.isfinite(y).any(1)
    tables = frames(spark, xy[keep], y[keep])
    options = dict(m=8, iters=60, start={"beta": np.zeros((1, 2)), "sigma": np.eye(2), "thetas": [(8.0, 1.0, 1.5, 0.1)] * 2}, nu=1.5, order="id")
    one, many = api.fit(*tables, **options), api.fit(*tables, **options, tiles=4, segment=25)
    assert np.abs(means(one, "Beta", 30) - means(many, "Beta", 30)).max() < 0.4
    assert np.abs(np.log(means(one, "Sigma", 30).diagonal() / means(many, "Sigma", 30).diagonal())).max() < 0.6
    a, b = (f.draws.filter("param = 'Y' and iter > 30").groupBy("i", "j").agg(F.avg("value").alias("v")).orderBy("i", "j").toPandas() for f in (one, many))
    assert (a[["i", "j"]] == b[["i", "j"]]).all().all() and len(a) == (~np.isfinite(y[keep])).sum()
    assert np.corrcoef(a["v"], b["v"])[0, 1] > 0.9
    assert len(api.imputed(many).select("loc_id", "outcome").distinct().collect()) == len(a)


def test_segments_of_tiles_give_the_chain_of_one_run(spark):
    tables = small_tables(spark, missing={(3, 1), (7, 2)})
    start = {"beta": np.zeros((2, 2)), "sigma": np.eye(2), "thetas": [(6.0, 1.0, 0.5, 0.1)] * 2, "noise": np.full(2, 0.1)}
    get = lambda **o: {(r.chain, r.iter, r.param, r.i, r.j): r.value for r in api.fit(*tables, m=5, iters=7, chains=2, start=start, tiles=3, **o).draws.collect()}
    whole, cut = get(), get(segment=3)
    assert whole.keys() == cut.keys() and max(abs(whole[k] - cut[k]) for k in whole) < 1e-9


def test_by_default_chains_of_many_places_go_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(api, "ONE_TASK", 30, raising=False)
    monkeypatch.setattr(tiles, "TILE_ROWS", 2)
    xy, y, _, thetas = simulated(60, 2, 0.5, 0.3, 21)
    start = {"beta": np.zeros((1, 2)), "sigma": np.eye(2), "thetas": [tuple(t) for t in thetas], "noise": np.full(2, 0.09)}
    fit = api.fit(*frames(spark, xy, y), m=4, iters=2, model="latent", start=start, order="id")
    assert fit.info["tiles"] == 4 and fit.draws.filter("param = 'W'").count() == 2 * 2 * 60  # no more than there are cores
    assert "tiles" not in api.fit(*frames(spark, xy, y), m=4, iters=2, model="latent", start=start | {"w": np.zeros((60, 2))}, order="id").info


def test_variational_fits_of_many_places_go_over_tiles(spark, monkeypatch):
    """Their estimates are near those of one task, and all places and missing outcomes are there."""
    xy, y, _, thetas = simulated(400, 2, 0.5, 0.3, 21, gone=0.05)
    start = {"beta": np.zeros((1, 2)), "sigma": np.eye(2), "thetas": [tuple(t) for t in thetas], "noise": np.full(2, 0.09)}
    options = dict(m=8, model="latent", method="vi", start=start, order="id", tol=0.03, predictive=3)
    one = api.fit(*frames(spark, xy, y), **options)
    monkeypatch.setattr(api, "CHAIN_ROWS", 100, raising=False)
    monkeypatch.setattr(api, "ONE_TASK", 100)
    monkeypatch.setattr(tiles, "TILE_ROWS", 100)
    many = api.fit(*frames(spark, xy, y), **options)
    assert many.info["tiles"] == 4 and "tiles" not in one.info
    count = lambda f: {(r["param"], r["count"]) for r in f.draws.filter("param not in ('rel_change')").groupBy("param").count().collect()}
    assert count(one) == count(many)
    a, b = ({(r.param, r.i, r.j): r.value for r in f.draws.filter("iter = 0").collect()} for f in (one, many))
    assert a.keys() == b.keys()
    far = lambda p: np.sqrt(np.mean([(a[k] - b[k]) ** 2 for k in a if k[0] == p]))
    assert far("W") < 0.1 and far("Sigma") < 0.1 and far("Ddiag") < 0.02 and far("Beta") < 0.15
    assert len(api.imputed(many).select("loc_id", "outcome").distinct().collect()) == (~np.isfinite(y)).sum()


def test_solves_over_tiles_are_those_of_one_task(spark):
    """H x is a whitened process; solved back over tiles it is the process."""
    xy, y, _, thetas = simulated(300, 2, 0.5, 0.3, 5)
    locs, obs, design = frames(spark, xy, y)
    edges, ranks = neighbors.ordered_knn(locs, 6), neighbors.ranked(locs).select("loc_id", "ord")
    start = {"beta": np.zeros((1, 2)), "sigma": np.eye(2), "thetas": [tuple(t) for t in thetas], "noise": np.ones(2)}
    dealt = tiles.tile_rows(api.model_rows(locs, obs, design, ranks, edges), ranks, locs, edges, None, 3)
    make = tiles.maker(start, [0.0, 0.0], {"latent": True}, 1)

    def run(batches):
        own = pa.Table.from_batches(batches)
        state, _ = make(own, own["tile"][0].as_py(), 1)
        off = max(np.abs(state.h_solve(f, state.v[:, [j]])[:, 0] - state.w[:, j]).max() for j, f in enumerate(state.factors))
        yield pa.RecordBatch.from_arrays([pa.array([len(state.w)]), pa.array([off])], ["n", "off"])

    numbers = spark.createDataFrame([(s, t) for t, s in enumerate(chains.slots(spark, 3))], "slot int, tile int")
    got = dealt.join(F.broadcast(numbers), "tile").repartition(3, "slot").mapInArrow(run, "n bigint, off double", barrier=True).collect()
    assert sum(r["n"] for r in got) == 300 and max(r["off"] for r in got) < 1e-9

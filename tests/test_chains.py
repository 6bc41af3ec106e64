"""Chains as streams: run once, in segments, gone on from where they stopped."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta
from terrane.models import api, chains, sampler
from test_models import START, simulated, small_tables, state_of


def values(fit):
    return {(r.chain, r.iter, r.param, r.i, r.j): r.value for r in fit.draws.collect()}


@pytest.mark.parametrize(("options", "latent"), [({"preconditioner": "posterior"}, True), ({"preconditioner": "auto"}, True), ({"sampler": sampler.SITE}, True), ({"sampler": sampler.OUTCOME}, True), ({}, False)])
def test_restored_chain_goes_on_as_if_it_had_not_stopped(options, latent):
    xy, y, _, thetas = simulated(80, 2, 0.4, 0.3, 5, gone=0.05)
    there = np.isfinite(y).any(1)
    xy, y = xy[there], y[there]

    def fresh():
        s = state_of(xy, y, list(thetas), 8, 0.3, update=(True, False, False, False), **options)
        return s if latent else sampler.State(s.y, s.x, s.graph, list(thetas), s.beta.copy(), s.sigma.copy(), s.noise.copy(), sampler.Options(latent=False, update=(True, False, False, True)))

    rng, other = np.random.default_rng(4), np.random.default_rng(99)
    whole = sampler.run_chain(fresh(), 14, rng)
    first = fresh()
    rng = np.random.default_rng(4)
    sampler.run_chain(first, 6, rng)
    kept = pickle.loads(pickle.dumps(first.snapshot(rng)))
    second = fresh()
    second.restore(kept, other)
    rest = sampler.run_chain(second, 8, other)
    assert all(np.array_equal(whole[k][6:], rest[k]) for k in rest)


def test_segments_give_the_chain_of_one_run(spark, tmp_path):
    tables = small_tables(spark, missing={(3, 1), (7, 2)})
    whole = api.fit(*tables, m=5, iters=9, chains=2, start=START)
    cut = api.fit(*tables, m=5, iters=9, chains=2, start=START, segment=4, store=str(tmp_path / "cut"))
    assert values(whole) == values(cut) and len(values(cut)) > 9 * 2 * 6
    short = api.fit(*tables, m=5, iters=4, chains=2, start=START, segment=4, store=str(tmp_path / "short"))
    assert max(k[1] for k in values(short)) == 4
    assert values(api.fit(*tables, m=5, iters=9, chains=2, start=START, segment=4, store=str(tmp_path / "short"))) == values(cut)
    with pytest.raises(ValueError, match="other data or options"):
        api.fit(*tables, m=6, iters=9, chains=2, start=START, segment=4, store=str(tmp_path / "short"))


def test_a_fit_runs_its_chains_once(spark, monkeypatch):
    """Counts, imputed values and predictions read what was stored."""
    locs, obs, design = small_tables(spark, missing={(3, 1), (7, 2)})
    ran = spark.sparkContext.accumulator(0)
    make = api.make_state

    def counted(*given):
        ran.add(1)
        return make(*given)

    monkeypatch.setattr(api, "make_state", counted)
    fit = api.fit(locs, obs, design, m=5, iters=3, start=START)
    assert ran.value == 1
    fit.draws.count()
    api.imputed(fit).collect()
    api.predict(fit, locs, obs, design, locs.limit(3), design).collect()
    assert ran.value == 1


def test_thinning_and_leaving_out_the_process(spark):
    tables = small_tables(spark)
    every = values(api.fit(*tables, m=5, iters=8, model="latent", start=START))
    some = values(api.fit(*tables, m=5, iters=8, model="latent", start=START, thin=3, keep_process=False))
    assert {k[1] for k in some} == {3, 6} and {k[2] for k in some} == {"Beta", "Sigma", "Theta", "Ddiag", "cg_iters"}
    assert all(every[k] == v for k, v in some.items())


def test_chains_are_dealt_to_tasks_of_their_own(spark):
    for n in (1, 3, 8):
        numbers = chains.slots(spark, n)
        rows = spark.createDataFrame([(s,) for s in numbers], "slot int").repartition(n, "slot")
        assert len(set(numbers)) == n and rows.groupBy(F.spark_partition_id()).count().count() == n


def test_one_observed_value_leaves_imputed_ones_finite():
    xy, y, sigma, thetas = simulated(40, 2, 0.5, 0.0, 4)
    y[1:, 1] = np.nan
    s = sampler.State(y, np.ones((40, 1)), state_of(xy, y, thetas, 5, 0.1).graph, [Theta(6.0)] * 2, np.zeros((1, 2)), sigma, np.ones(2), sampler.Options(latent=False))
    got = sampler.run_chain(s, 3, np.random.default_rng(1))
    assert np.isfinite(got["Y"]).all()

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta, covariance, distances
from terrane.models import api
from terrane.models.linalg import Graph, column_products, pcg, wishart
from terrane.operators import crosscov, neighbors, vecchia
from terrane.sources import tables

THETA = Theta(6.0, 1.0, 1.5, 0.1)


def places(n, seed=0):
    return np.random.default_rng(seed).random((n, 2))


def full(n):
    return [list(range(i)) for i in range(n)]


def near(xy, m):
    d = distances(xy, xy)
    return [list(np.argsort(d[i, :i], kind="stable")[:m]) for i in range(len(xy))]


def frame(spark, xy):
    return spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))


def test_all_predecessors_give_the_cholesky_factor():
    xy = places(40)
    f = Graph(xy, full(40)).factor(THETA)
    c = covariance(distances(xy, xy), THETA)
    chol = np.linalg.cholesky(c)
    assert np.allclose(f.dense(), np.linalg.inv(chol), atol=1e-8)
    assert f.logdet == pytest.approx(-np.linalg.slogdet(c)[1])


def test_products_and_solves_agree_with_dense():
    xy = places(60)
    f = Graph(xy, near(xy, 6)).factor(THETA)
    h, a = f.dense(), np.random.default_rng(1).standard_normal(60)
    assert np.allclose(f.times(a), h @ a)
    assert np.allclose(f.transposed_times(a), h.T @ a)
    assert np.allclose(f.solve(a), np.linalg.solve(h, a))
    lv = f.graph.levels
    assert np.allclose(lv.transposed_solve(f.sqrt_r, f.h, a[:, None])[:, 0], np.linalg.solve(h.T, a))
    assert np.allclose(column_products(f, f), (h * h).sum(0))


def test_spark_factors_agree_with_numpy(spark):
    xy = places(50)
    p = frame(spark, xy)
    got = vecchia.factors(p, neighbors.ordered_knn(p, 5), (THETA,)).orderBy("node").toPandas()
    f = Graph(xy, near(xy, 5)).factor(THETA)
    assert np.allclose(got["sqrt_r"], f.sqrt_r)
    dense = np.zeros((50, 50))
    for r in vecchia.entries(vecchia.factors(p, neighbors.ordered_knn(p, 5), (THETA,))).collect():
        dense[r["i"], r["j"]] = r["v"]
    assert np.allclose(dense, f.dense())


def test_one_place_and_fewer_than_m(spark):
    for n in (1, 3):
        p = frame(spark, places(n))
        e = neighbors.ordered_knn(p, 10)
        assert e.count() == n * (n - 1) // 2
        assert vecchia.factors(p, e, (THETA,)).count() == n


def test_same_place_twice_is_an_error(spark):
    xy = np.array([[0.1, 0.2], [0.5, 0.5], [0.1, 0.2]])
    p = frame(spark, xy)
    with pytest.raises(Exception, match="no factor|not positive"):
        vecchia.factors(p, neighbors.ordered_knn(p, 2), (THETA,)).collect()
    obs = p.select("loc_id", F.lit(1).alias("outcome"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="same_place"):
        tables.check(p, obs, p.select("loc_id", F.array(F.lit(1.0)).alias("x")))


@pytest.mark.parametrize("clustered", [False, True])
def test_cells_find_what_brute_force_finds(spark, clustered):
    xy = places(400, 3)
    if clustered:
        xy = np.concatenate([xy[:200] * 0.01, xy[200:]])
    p = frame(spark, xy)
    a = {(r.node, r.parent, r.k) for r in neighbors.ordered_knn_cells(p, 6).collect()}
    assert a == {(r.node, r.parent, r.k) for r in neighbors.ordered_knn(p, 6).collect()}
    train, new = p.filter("loc_id % 7 != 0"), p.filter("loc_id % 7 = 0")
    b = {(r.node, r.parent, r.k) for r in neighbors.knn(train, new, 6, small=0).collect()}
    assert b == {(r.node, r.parent, r.k) for r in neighbors.knn(train, new, 6).collect()}


def test_max_min_order():
    xy = places(80, 5)
    order = neighbors.max_min_order(xy)
    assert sorted(order) == list(range(80))
    for i in range(1, 80):
        gap = distances(xy, xy[order[:i]]).min(1)
        assert gap[order[i]] == pytest.approx(gap.max())


def test_stencil_rows_and_columns(spark):
    for shape in ((1, 6), (6, 1)):
        rows = [(i, i % shape[0], i // shape[0]) for i in range(6)]
        g = spark.createDataFrame(rows, "loc_id bigint, gx int, gy int")
        dag = neighbors.grid_dag(g, 15)
        assert dag.groupBy("node").count().count() == 5
        assert dag.filter("parent >= node").count() == 0


def test_colours_are_proper():
    xy = places(70)
    g = Graph(xy, near(xy, 4))
    of = {int(i): c for c, rows in enumerate(g.colors()) for i in rows}
    assert all(of[i] != of[j] for i, b in enumerate(g.blanket()) for j in b)


def test_cross_correlation_of_two_outcomes(spark):
    s, x = places(12, 1), places(7, 2)
    thetas = (Theta(5.0), Theta(8.0, 1.0, 1.5, 0.2))
    got = crosscov.pairwise(frame(spark, x), frame(spark, s), frame(spark, s), [(1, 2)], thetas).toPandas()
    chol = [np.linalg.cholesky(covariance(distances(s, s), t)) for t in thetas]
    a = np.linalg.solve(chol[0], covariance(distances(s, x), thetas[0]))
    b = np.linalg.solve(chol[1], covariance(distances(s, s), thetas[1]))
    assert np.allclose(got.pivot(index="x_id", columns="y_id", values="value").to_numpy(), a.T @ b)


def test_conjugate_gradients_and_wishart():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a = a @ a.T + np.eye(30)
    b = rng.standard_normal(30)
    x, k = pcg(lambda u: a @ u, b, lambda u: u / np.diag(a), 1e-10, 500)
    assert np.allclose(a @ x, b, atol=1e-7) and k < 200
    scale = np.array([[1.0, 0.4], [0.4, 2.0]])
    mean = np.mean([wishart(rng, scale, 9) for _ in range(4000)], axis=0)
    assert np.allclose(mean, 9 * scale, rtol=0.08)




def test_bins_and_factors_at_zero_against_dense_algebra(spark, monkeypatch):
    xy, thetas, m = places(40, 6), (Theta(5.0), Theta(8.0, 1.0, 1.5, 0.2)), 5
    p = frame(spark, xy)
    edges = neighbors.ordered_knn(p, m)
    g = Graph(xy, near(xy, m))
    l = [np.linalg.inv(g.factor(t).dense()) for t in thetas]
    monkeypatch.setattr(crosscov, "COLUMNS", 16)
    got = crosscov.binned(p, edges, thetas, 1, 2, bins=7, most=0.6).orderBy("bin").toPandas()
    d, c = distances(xy, xy), l[0] @ l[1].T
    at = np.minimum(np.floor(d / (0.6 / 7)), 6)
    for r in got.itertuples():
        own = (at == r.bin) & (d <= 0.6)
        assert r.pairs == own.sum() and r.value == pytest.approx(c[own].mean())
    assert got["pairs"].sum() == (d <= 0.6).sum()
    theta = spark.createDataFrame([(1, it, j, *t) for it in (1, 2) for j, t in enumerate(thetas, 1)], "chain int, iter int, outcome int, phi double, sigmasq double, nu double, alpha double")
    zero = {(r.iter, r.i, r.j): r.value for r in crosscov.zero_draws(p, edges, theta).collect()}
    assert len(zero) == 6
    for (_, i, j), v in zero.items():
        assert v == pytest.approx((l[i - 1] * l[j - 1]).sum() / 40)


def test_scaling_factor_is_symmetric_and_near_one_of_one_outcome(spark):
    xy = places(60, 7)
    got = {(r.i, r.j): r.value for r in crosscov.scaling_factor(frame(spark, xy), (Theta(5.0), Theta(9.0)), m=10, most=30).collect()}
    assert got[1, 2] == got[2, 1] and got[1, 2] < 1
    assert got[1, 1] == pytest.approx(1, abs=0.02)  # rows of L have norm 1, but for what the approximation leaves
    keep = np.round(np.linspace(0, 59, 30)).astype(int)  # by dense algebra, in max-min order
    s = xy[keep][neighbors.max_min_order(xy[keep])]
    l = [np.linalg.inv(Graph(s, near(s, 10)).factor(t).dense()) for t in (Theta(5.0), Theta(9.0))]
    assert got[1, 2] == pytest.approx((l[0] * l[1]).sum() / 30)


def test_a_grid_shares_factors(spark):
    rows = [(100 + i, 0.2 * (i % 7), 1.5 - 0.5 * (i // 7)) for i in range(35)]
    p = spark.createDataFrame(rows, "loc_id bigint, x double, y double")
    thetas = (Theta(3.0), Theta(4.0, 1.0, 1.5, 0.1))
    own = vecchia.build(p, thetas, 6, order="grid")
    general = {(r.outcome, r.node): (r.sqrt_r, r.parents, r.h) for r in vecchia.factors(p, own.edges, thetas).collect()}
    shared = own.factors.collect()
    assert len(shared) == 70
    for r in shared:
        sqrt_r, parents, h = general[r.outcome, r.node]
        assert r.sqrt_r == pytest.approx(sqrt_r) and r.parents == parents and r.h == pytest.approx(h)
    with pytest.raises(ValueError):
        neighbors.vecchia_dag(p.filter("loc_id != 110"), 6, "grid")
    assert neighbors.vecchia_dag(p.filter("loc_id = 110"), 6, "grid").count() == 0


def test_steps_of_a_sweep():
    xy = places(90, 8)
    g = Graph(xy, near(xy, 6))
    f = g.factor(Theta(5.0))
    a = np.random.default_rng(1).standard_normal(90)
    assert sorted(np.concatenate([s.rows for s in g.steps()])) == list(range(90))
    h = f.dense()
    for s in g.steps():
        assert np.allclose(f.transposed_times_at(a, s), (h.T @ a)[s.rows])
        assert np.allclose(f.times_at(a, s.touched), (h @ a)[s.touched])
        assert set(s.touched) == set(np.flatnonzero(np.abs(h[:, s.rows]).sum(1) > 0))


@pytest.mark.parametrize("transposed", [False, True])
def test_solves_over_tasks_are_those_of_dense_algebra(spark, transposed):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(7 * i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((120, 2)))], "loc_id bigint, x double, y double")
    f = vecchia.factors(points, neighbors.ordered_knn(points, 6), [Theta(6.0), Theta(9.0, nu=1.5)]).persist()
    a = spark.createDataFrame([(j, 7 * i, float(v)) for j in (1, 2) for i, v in enumerate(rng.normal(size=120))], "outcome int, loc_id bigint, a double")
    right = {(r["outcome"], r["loc_id"]): r["a"] for r in a.collect()}
    dense = np.zeros((3, 120, 120))
    for r in vecchia.entries(f).collect():
        dense[r["outcome"], r["i"] // 7, r["j"] // 7] += r["v"]
    for tasks in (1, 3):
        got = {(r["outcome"], r["loc_id"]): r["v"] for r in vecchia.inverse_times(f, a, transposed, tasks).collect()}
        for j in (1, 2):
            want = np.linalg.solve(dense[j].T if transposed else dense[j], [right[j, 7 * i] for i in range(120)])
            assert np.allclose([got[j, 7 * i] for i in range(120)], want)


def test_maxmin_is_that_of_the_plain_rule():
    def plain(xy):
        order, near = [int(np.argmin(((xy - xy.mean(0)) ** 2).sum(1)))], np.full(len(xy), np.inf)
        while len(order) < len(xy):
            near = np.minimum(near, ((xy - xy[order[-1]]) ** 2).sum(1))
            near[order] = -1.0
            order.append(int(np.argmax(near)))
        return order

    rng = np.random.default_rng(3)
    gx, gy = np.meshgrid(np.arange(20) * 0.1, np.arange(15) * 0.1)
    line = np.column_stack([np.zeros(200), rng.random(200)])
    clustered = np.concatenate([rng.random((60, 2)), 0.5 + 1e-4 * rng.random((540, 2))])
    for xy in (rng.random((700, 2)), np.column_stack([gx.ravel(), gy.ravel()]), line, clustered, np.repeat(rng.random((30, 2)), 3, 0), rng.random((1, 2))):
        assert neighbors.max_min_order(xy).tolist() == plain(xy)


def test_grid_shares_factors_within_a_chain():
    gx, gy = np.meshgrid(np.arange(30) * 0.1, np.arange(20) * 0.1)
    xy = np.column_stack([gx.ravel(), gy.ravel()])
    parents = [[j for j in (i - 1, i - 30, i - 31) if j >= 0 and abs(j % 30 - i % 30) <= 1] for i in range(600)]
    shared = Graph(xy, parents)
    assert sum(len(among) for _, _, among, _, _ in shared.groups) < 20
    shaken = Graph(xy + 1e-7 * np.random.default_rng(1).random(xy.shape), parents)
    assert all(same is None for *_, same in shaken.groups)
    a, b = shared.factor(Theta(5.0, 1.0, 1.5)), shaken.factor(Theta(5.0, 1.0, 1.5))
    assert np.allclose(a.h, b.h, atol=1e-4) and np.allclose(a.sqrt_r, b.sqrt_r, atol=1e-5)


@pytest.mark.parametrize("kind", ["even", "clustered", "ties"])
def test_neighbours_by_tiles_are_those_of_a_plain_search(spark, kind):
    """Tiles of a bounded number of points, wherever most of them are; ties to the smaller id."""
    rng = np.random.default_rng(6)
    n, m, block = 700, 5, 60
    xy = rng.random((n, 2))
    if kind == "clustered":
        xy[rng.permutation(n)[: int(0.9 * n)]] = 0.3 + 1e-4 * rng.random((int(0.9 * n), 2))
    elif kind == "ties":
        xy = np.array([(i % 28, i // 28) for i in rng.permutation(n)]) * 0.125
    points = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]}))
    got = {}
    for r in neighbors.ordered_knn_cells(points, m, block).collect():
        got.setdefault(r["node"], []).append((r["k"], r["parent"]))
    d2 = (xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2
    for i in range(n):
        want = sorted(range(i), key=lambda j: (d2[i, j], j))[:m]  # noqa: B023
        assert [p for _, p in sorted(got.get(i, []))] == want
    new = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(40), "x": rng.random(40) * 1.5, "y": rng.random(40)}))
    near = neighbors.knn(points, new, m, small=10).collect()
    at = {r["loc_id"]: (r["x"], r["y"]) for r in new.collect()}
    for i, (x, y) in at.items():
        far = (x - xy[:, 0]) ** 2 + (y - xy[:, 1]) ** 2
        assert [r["parent"] for r in sorted((r for r in near if r["node"] == i), key=lambda r: r["k"])] == sorted(range(n), key=lambda j: (far[j], j))[:m]  # noqa: B023


def test_tiles_of_clustered_points_are_even():
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.random((1000, 2)), 0.3 + 1e-4 * rng.random((9000, 2))])
    tree = neighbors.cuts(xy[rng.permutation(10_000)[:2000]], 20)
    sizes = np.bincount(tree.tiles(xy))
    assert len(sizes) == 20 and sizes.max() < 800


def test_nuggets_by_place_are_on_the_diagonal(spark):
    """All earlier places as parents: H is the inverse Cholesky factor of the covariance with each place's own nugget."""
    rng = np.random.default_rng(4)
    xy, own = rng.random((30, 2)), rng.random(30)
    points = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(30), "x": xy[:, 0], "y": xy[:, 1], "nugget": own}))
    theta = Theta(6.0, 1.0, 1.5)
    f = vecchia.factors(points, neighbors.ordered_knn(points, 29), [theta], nugget=0.1)
    dense = np.zeros((30, 30))
    for r in vecchia.entries(f).collect():
        dense[r["i"], r["j"]] = r["v"]
    assert np.allclose(dense, np.linalg.inv(np.linalg.cholesky(covariance(distances(xy, xy), theta) + np.diag(0.1 + own))), atol=1e-8)
    with pytest.raises(ValueError, match="share no factors"):
        vecchia.grid_factors(points, neighbors.ordered_knn(points, 3), [theta])


def test_all_pairs_of_more_points_than_are_broadcast(spark, monkeypatch):
    xy, theta = places(30, 8), Theta(5.0)
    monkeypatch.setattr(neighbors, "SMALL", 8)
    got = crosscov.cross_correlation(frame(spark, xy), frame(spark, xy), theta).toPandas().pivot(index="a", columns="b", values="c")
    assert np.allclose(got.to_numpy(), covariance(distances(xy, xy), theta))


def test_correlation_given_a_large_reference_set(spark, monkeypatch):
    s, x, thetas = places(12, 1), np.concatenate([places(12, 1)[:5], places(7, 2)]), (Theta(5.0), Theta(8.0, 1.0, 1.5, 0.2))
    for at_limit in (False, True):
        got, want = (f(frame(spark, x), frame(spark, x), frame(spark, s), [(2, 2)], thetas, at_limit=at_limit).toPandas() for f in (crosscov.pairwise, crosscov._through))
        got, want = (t.pivot(index="x_id", columns="y_id", values="value").to_numpy() for t in (got, want))
        assert got.shape == (12, 12) and np.allclose(got, want, atol=1e-7)
    monkeypatch.setattr(crosscov, "DENSE", 5)
    monkeypatch.setattr(neighbors, "SMALL", 5)
    got = crosscov.pairwise(frame(spark, s), frame(spark, s), frame(spark, s), [(2, 2)], thetas).toPandas()
    assert np.allclose(got.pivot(index="x_id", columns="y_id", values="value").to_numpy(), covariance(distances(s, s), thetas[1]))
    own = crosscov.pairwise(frame(spark, s), frame(spark, s), frame(spark, s), [(1, 1), (2, 2)], thetas, diagonal=True).toPandas()
    assert len(own) == 24 and np.allclose(own["value"], 1) and (own["x_id"] == own["y_id"]).all()


@pytest.mark.parametrize("m", [1, 4])
def test_lower_factors_of_more_places_than_a_dense_matrix(spark, monkeypatch, m):
    xy, thetas = places(40, 6), (Theta(5.0), Theta(8.0, 1.0, 1.5, 0.2))
    for name, value in (("DENSE", 10), ("COLUMNS", 16), ("CELLS", 200)):
        monkeypatch.setattr(crosscov, name, value, raising=False)
    p = frame(spark, xy)
    edges = neighbors.ordered_knn(p, m)
    g = Graph(xy, near(xy, m))
    l = [np.linalg.inv(g.factor(t).dense()) for t in thetas]
    low = crosscov.lower(vecchia.factors(p, edges, thetas))
    got = np.zeros((2, 40, 40))
    for r in low.collect():
        assert r.v != 0 and not got[r.outcome - 1, r.s, r.t]
        got[r.outcome - 1, r.s, r.t] = r.v
    assert np.allclose(got, l)
    zero = {(r.i, r.j): r.value for r in crosscov.at_zero(low).collect()}
    theta = spark.createDataFrame([(1, 1, j, *t) for j, t in enumerate(thetas, 1)], "chain int, iter int, outcome int, phi double, sigmasq double, nu double, alpha double")
    drawn = {(r.i, r.j): r.value for r in crosscov.zero_draws(p, edges, theta).collect()}
    assert set(zero) == set(drawn) == {(1, 1), (2, 1), (2, 2)}
    for (i, j), v in zero.items():
        assert v == pytest.approx((l[i - 1] * l[j - 1]).sum() / 40) and drawn[i, j] == pytest.approx(v)
    d, c = distances(xy, xy), l[0] @ l[1].T
    bins = crosscov.binned_draws(p, edges, theta, 1, 2, bins=7, most=0.6).collect()
    assert sum(r.pairs for r in bins) == (d <= 0.6).sum()
    for r in bins:
        assert r.value == pytest.approx(c[(np.minimum(np.floor(d / (0.6 / 7)), 6) == r.bin) & (d <= 0.6)].mean())


def test_grid_parents_over_tiles_with_holes_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SIDE", 4, raising=False)
    cells = [(i, i % 11 - 3, i // 11 - 2) for i in range(121) if i % 7]
    cells.append((500, *cells[20][1:]))  # a second place in one cell
    steps, want = neighbors.stencil(15), set()
    for node, x, y in cells:
        near = sorted((o, other) for other, a, b in cells for o, (dx, dy) in enumerate(steps) if (a, b) == (x + dx, y + dy))
        want |= {(node, other, k, *steps[o]) for k, (o, other) in enumerate(near[:15], 1)}
    grid = spark.createDataFrame(cells, "loc_id bigint, gx int, gy int")
    dag = neighbors.grid_dag(grid, 15)
    assert {tuple(r) for r in dag.collect()} == want and dag.count() == len(want)
    of = lambda d: sorted(map(tuple, d.select("pattern", "nodes", "exemplar").collect()))
    assert of(neighbors.patterns_of(neighbors.grid_parents(grid, 15))) == of(neighbors.grid_patterns(dag))
    # As many rows go through an exchange as there are cells, or some more; not one for each offset.
    assert "Window" not in dag._jdf.queryExecution().executedPlan().toString()


def test_max_min_order_does_not_depend_on_the_number_of_places(spark, monkeypatch):
    """However many places there seem to be, fits and graphs have the exact order; the one by levels is to be asked for."""
    xy = np.random.default_rng(5).uniform(size=(300, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "loc_id bigint, x double, y double")
    exact = neighbors.max_min_order(xy).tolist()
    want = {tuple(r) for r in neighbors.vecchia_dag(points, 3).select("node", "parent", "k").collect()}
    monkeypatch.setattr(type(points), "count", lambda self: 10**7)
    assert [r["loc_id"] for r in api.ordered(points, "maxmin").orderBy("ord").collect()] == exact
    assert {tuple(r) for r in neighbors.vecchia_dag(points, 3).select("node", "parent", "k").collect()} == want
    assert [r["loc_id"] for r in api.ordered(points, "levels").orderBy("ord").collect()] != exact


def test_columns_of_bins_end_at_the_diagonal(spark):
    """Half of the pairs are made, and bins of one outcome and of two have both orders of each pair."""
    xy = places(70, 4)
    parents = near(xy, 4)
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xy)], "loc_id bigint, x double, y double")
    edges = spark.createDataFrame([(i, int(q), k) for i, ps in enumerate(parents) for k, q in enumerate(ps, 1)], "node bigint, parent bigint, k int")
    thetas, graph, d = [THETA, Theta(9.0, 1.0, 0.5, 0.0)], Graph(xy, parents), distances(xy, xy)
    l = [np.linalg.inv(graph.factor(t).dense()) for t in thetas]
    net = crosscov._by_depth(crosscov.net(p, edges))
    made = [crosscov._factor(net, np.arange(70), t, 1) for t in thetas]
    part = np.array([5, 20, 33])
    got = crosscov._down_to(net, part, *made)
    assert got.shape == (34, 3) and np.allclose(got, (l[0] @ l[1].T)[np.ix_(net.ids[:34], net.ids[part])])
    for i, j in ((1, 2), (2, 1), (1, 1)):
        c = l[i - 1] @ l[j - 1].T
        bin_ = np.where(d <= 0.6, np.minimum((d / (0.6 / 7)).astype(int), 6), 7)
        for r in crosscov.binned(p, edges, thetas, i, j, bins=7, most=0.6).collect():
            assert r["pairs"] == (bin_ == r["bin"]).sum() and r["value"] == pytest.approx(c[bin_ == r["bin"]].mean())

"""Queries of the set-shaped operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import kernels as K
from terrane.functions import transforms as tr
from terrane.operators import crosscov, draws, moments, neighbors, vecchia
from terrane.sources import fixtures as fx
from terrane.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EXPONENTIAL = K.Theta(6.0)

# SQL of the fixtures.
IRR = (
    "irr AS MATERIALIZED (SELECT vec_id AS loc_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z1, "
    "CAST(embedding[4] AS DOUBLE) AS z2, CAST(embedding[5] AS DOUBLE) AS z3, CAST(embedding[6] AS DOUBLE) AS c1 FROM embeddings)"
)
OBS = f"{IRR}, obs AS (SELECT loc_id, unnest([1, 2, 3]) AS outcome, unnest([z1, z2, z3]) AS y FROM irr)"
MISS = f"{OBS}, miss AS (SELECT loc_id, outcome, CASE WHEN (loc_id * 7 + outcome) % 11 = 0 THEN NULL ELSE y END AS y FROM obs)"
GRID = "grid AS MATERIALIZED (SELECT CAST(c_custkey AS BIGINT) AS loc_id, CAST(c_custkey % 50 AS INTEGER) AS gx, CAST(c_custkey // 50 AS INTEGER) AS gy, CAST(c_acctbal AS DOUBLE) AS z FROM customer)"
CHAIN = "chain AS MATERIALIZED (SELECT CAST(user_id AS BIGINT) AS chain, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS iter, CAST(value AS DOUBLE) AS value FROM events)"


def nn(m: int, points: str = "irr", new: str | None = None, name: str = "nn") -> str:
    """SQL of nearest neighbours: among earlier points, or of new rows among points."""
    on = "ON b.loc_id < a.loc_id" if new is None else "ON TRUE"
    return (
        f"{name} AS MATERIALIZED (SELECT node, parent, k, d FROM (SELECT a.loc_id AS node, b.loc_id AS parent, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, "
        f"CAST(row_number() OVER (PARTITION BY a.loc_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.loc_id) AS INTEGER) AS k FROM {new or points} a JOIN {points} b {on}) WHERE k <= {m})"
    )


def kernel(d: str, t: K.Theta, family: int = K.MATERN) -> str:
    """SQL of a kernel in closed form."""
    p = f"({d}) * {t.phi!r}"
    if family == K.POWER_EXPONENTIAL:
        rho = f"exp(-{t.phi!r} * pow({d}, {t.nu!r}))"
    elif family == K.WAVE:
        rho = f"exp(-{p}) * cos({t.nu!r} * ({d}))"
    else:
        rho = {0.5: f"exp(-{p})", 1.5: f"(1 + {p}) * exp(-{p})", 2.5: f"(1 + {p} + {p} * {p} / 3) * exp(-{p})"}[t.nu]
    return f"CASE WHEN ({d}) = 0 THEN {t.sigmasq!r} ELSE {(1 - t.alpha) * t.sigmasq!r} * {rho} END"


def vecchia2(thetas: tuple[K.Theta, ...], points: str = "irr", new: str | None = None, edges: str = "nn", name: str = "fac") -> str:
    """SQL of factors for two parents at most, in closed form: outcome, node, p1, p2, h1, h2, r2."""
    parts = []
    for j, t in enumerate(thetas, 1):
        c1, c2 = kernel("d1", t), kernel("d2", t)
        c12 = kernel("d12", t)
        s = repr(t.sigmasq)
        parts.append(
            f"SELECT {j} AS outcome, node, p1, p2, CASE WHEN p1 IS NULL THEN NULL WHEN p2 IS NULL THEN c1 / {s} ELSE (c1 * {s} - c2 * c12) / ({s} * {s} - c12 * c12) END AS h1, "
            f"CASE WHEN p2 IS NULL THEN NULL ELSE (c2 * {s} - c1 * c12) / ({s} * {s} - c12 * c12) END AS h2, {s} AS s, c1, c2 "
            f"FROM (SELECT *, {c1} AS c1, {c2} AS c2, {c12} AS c12 FROM wide_{name})"
        )
    return (
        f"wide_{name} AS MATERIALIZED (SELECT a.loc_id AS node, e.parent AS p1, f.parent AS p2, e.d AS d1, f.d AS d2, sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)) AS d12 "
        f"FROM {new or points} a LEFT JOIN {edges} e ON e.node = a.loc_id AND e.k = 1 LEFT JOIN {edges} f ON f.node = a.loc_id AND f.k = 2 LEFT JOIN {points} b ON b.loc_id = e.parent LEFT JOIN {points} c ON c.loc_id = f.parent), "
        f"{name} AS MATERIALIZED (SELECT outcome, node, p1, p2, h1, h2, s - coalesce(c1 * h1, 0) - coalesce(c2 * h2, 0) AS r2 FROM ({' UNION ALL '.join(parts)}))"
    )


ENTRIES = (
    "h AS MATERIALIZED (SELECT outcome, node AS i, node AS j, 1 / sqrt(r2) AS v FROM fac UNION ALL SELECT outcome, node, p1, -h1 / sqrt(r2) FROM fac WHERE p1 IS NOT NULL "
    "UNION ALL SELECT outcome, node, p2, -h2 / sqrt(r2) FROM fac WHERE p2 IS NOT NULL)"
)
V2 = f"{OBS}, {nn(2)}, {vecchia2(fx.THETAS)}, {ENTRIES}"
WHITE = "v AS MATERIALIZED (SELECT h.outcome, h.i AS loc_id, sum(h.v * o.y) AS v FROM h JOIN obs o ON o.outcome = h.outcome AND o.loc_id = h.j GROUP BY ALL)"


def rounded(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name) if name else F.round(c, 6) + F.lit(0.0)


def r(sql: str, name: str) -> str:
    return f"round({sql}, 6) + 0.0 AS {name}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Kernels, on the distances of points to their two nearest earlier ones.
def _kernel_query(name: str, theta: K.Theta, family: int) -> None:
    @query(name, f"WITH {IRR}, {nn(2)} SELECT node, parent, {r(kernel('d', theta, family), 'c')} FROM nn")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = neighbors.ordered_knn(fx.points(spark, sf_dir), 2)
        return near.select("node", "parent", rounded(K.covariance_column(F.col("d"), theta, family), "c"))


for _name, _theta, _family in (
    ("cov_exp", K.Theta(6.0, 1.0, 0.5, 0.0), K.MATERN),
    ("cov_matern15", K.Theta(9.0, 1.0, 1.5, 0.1), K.MATERN),
    ("cov_matern25", K.Theta(12.0, 2.0, 2.5, 0.2), K.MATERN),
    ("cov_powexp", K.Theta(6.0, 1.5, 1.3, 0.1), K.POWER_EXPONENTIAL),
    ("cov_wave", K.Theta(6.0, 1.0, 4.0, 0.05), K.WAVE),
):
    _kernel_query(_name, _theta, _family)


@query("cov_matern_general", f"WITH {IRR}, {nn(2)} SELECT node, parent, {r(kernel('d', K.Theta(9.0, 1.0, 1.5, 0.1)), 'c')} FROM nn")
def cov_matern_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for any smoothness, at one for which there is a closed form to compare with."""
    near = neighbors.ordered_knn(fx.points(spark, sf_dir), 2)
    t = K.Theta(9.0, 1.0, 1.5 + 1e-12, 0.1)
    return near.select("node", "parent", rounded(K.general_matern(F.col("d"), t), "c"))


def bessel(d: str, nu: float) -> str:
    """SQL of the Matern correlation at d = t by the trapezoid rule for the integral of exp(-t cosh s) cosh(nu s)."""
    return f"2 / gamma({nu}) * pow({d} / 2, {nu}) * list_sum(list_transform(range(0, 400), lambda k: exp(-{d} * cosh(k * 0.05)) * cosh({nu} * k * 0.05) * CASE WHEN k = 0 THEN 0.025 ELSE 0.05 END))"


@query("cov_matern_bessel", f"WITH {IRR}, {nn(2)} SELECT node, parent, " + ", ".join(f"{r(f'0.9 * ({bessel("(d * 9)", nu)})', name)}" for name, nu in (("c08", 0.8), ("c12", 1.2), ("c1", 1.0))) + " FROM nn")
def cov_matern_bessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothness without a closed form, in column functions; SQL has the Bessel function's integral."""
    near = neighbors.ordered_knn(fx.points(spark, sf_dir), 2)
    return near.select("node", "parent", *(rounded(K.covariance_column(F.col("d"), K.Theta(9.0, 1.0, nu, 0.1)), name) for name, nu in (("c08", 0.8), ("c12", 1.2), ("c1", 1.0))))


@query("cov_zero_distance", f"WITH {IRR} SELECT loc_id, {r(kernel('x - x', K.Theta(9.0, 2.0, 1.5, 0.3)), 'c')} FROM irr")
def cov_zero_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).select("loc_id", rounded(K.covariance_column(F.col("x") - F.col("x"), K.Theta(9.0, 2.0, 1.5, 0.3)), "c"))


@query("correlation_matrix", f"WITH {IRR} SELECT a.loc_id AS a, b.loc_id AS b, {r(kernel('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', K.Theta(9.0, 1.0, 1.5, 0.1)), 'c')} FROM irr a CROSS JOIN irr b")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix between two sets of points, here of all with all, as rows; the second set's size is checked."""
    p = fx.points(spark, sf_dir)
    return crosscov.cross_correlation(p, p, K.Theta(9.0, 1.0, 1.5, 0.1)).select("a", "b", rounded("c", "c"))


# Ingestion, checks and filters.
@query("ingest_observations", f"WITH {OBS} SELECT loc_id, outcome, {r('y', 'y')} FROM obs")
def ingest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.outcomes(spark, sf_dir).select("loc_id", "outcome", rounded("y", "y"))


@query(
    "validate_tables",
    f"WITH {IRR}, l AS (SELECT loc_id, CASE WHEN loc_id % 9 = 1 THEN NULL ELSE x END AS x, y FROM irr UNION ALL SELECT loc_id, x, y FROM irr WHERE loc_id % 7 = 0 AND loc_id % 9 <> 1) "
    "SELECT (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM l GROUP BY x, y)) AS same_place, (SELECT count(*) - count(DISTINCT loc_id) FROM l) AS same_id, count(*) FILTER (WHERE loc_id % 9 = 1) AS bad_place, "
    "3 * count(*) FILTER (WHERE loc_id % 11 = 2) AS bad_outcome, count(*) FILTER (WHERE loc_id % 13 = 5) AS bad_covariate, 3 * count(*) FILTER (WHERE loc_id % 17 = 3) AS lost FROM irr",
)
def validate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of faults in tables that have all of them: repeated places, gaps, infinite values, outcomes of places that are not there."""
    p = fx.points(spark, sf_dir)
    gaps = p.withColumn("x", F.when(F.col("loc_id") % 9 != 1, F.col("x")))
    locs = gaps.unionByName(p.filter("loc_id % 7 = 0 AND loc_id % 9 != 1"))
    obs = fx.outcomes(spark, sf_dir).withColumn("y", F.when(F.col("loc_id") % 11 == 2, F.lit(float("inf"))).otherwise(F.col("y")))
    obs = obs.unionByName(obs.filter("loc_id % 17 = 3").withColumn("loc_id", -F.col("loc_id")).withColumn("y", F.lit(0.0)))
    x = fx.covariates(spark, sf_dir).withColumn("x", F.when(F.col("loc_id") % 13 == 5, F.array(F.lit(1.0), F.lit(None).cast("double"))).otherwise(F.col("x")))
    return tables.faults(locs, obs, x)


@query("complete_cases", f"WITH {MISS} SELECT loc_id, outcome, {r('y', 'y')} FROM miss WHERE loc_id IN (SELECT loc_id FROM miss GROUP BY loc_id HAVING count(y) = 3)")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.complete_cases(fx.outcomes_missing(spark, sf_dir)).select("loc_id", "outcome", rounded("y", "y"))


@query("missing_map", f"WITH {MISS}, s AS (SELECT *, count(y) OVER (PARTITION BY loc_id) > 0 AS any_y FROM miss) SELECT outcome, count(y) AS available, count(*) - count(y) AS missing, CAST(count(*) FILTER (WHERE y IS NULL AND any_y) AS BIGINT) AS partly FROM s GROUP BY outcome")
def missing_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.missing_map(fx.outcomes_missing(spark, sf_dir))


@query("fully_missing", f"WITH {MISS}, t AS (SELECT loc_id, outcome, CASE WHEN loc_id % 50 = 3 THEN NULL ELSE y END AS y FROM miss) SELECT loc_id FROM t GROUP BY loc_id HAVING count(y) = 0")
def fully_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.fully_missing(fx.outcomes_missing(spark, sf_dir).withColumn("y", F.when(F.col("loc_id") % 50 != 3, F.col("y"))))


BETA = {1: [0.1, 0.5], 2: [-0.2, 1.0], 3: [0.0, -0.7]}
RES = "res AS MATERIALIZED (SELECT m.loc_id, m.outcome, m.y - (CASE m.outcome WHEN 1 THEN 0.1 WHEN 2 THEN -0.2 ELSE 0.0 END + c1 * CASE m.outcome WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE -0.7 END) AS e FROM miss m JOIN irr USING (loc_id))"


@query("residual", f"WITH {MISS}, {RES} SELECT loc_id, outcome, {r('e', 'e')} FROM res")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.residual(fx.outcomes_missing(spark, sf_dir), fx.covariates(spark, sf_dir), BETA).select("loc_id", "outcome", rounded("e", "e"))


@query("thin", "SELECT vec_id AS loc_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS nth, count(*) OVER () AS n FROM embeddings) WHERE nth IN (SELECT CAST(round_even(1 + i * (e.n - 1) / 99.0, 0) AS BIGINT) FROM range(100) t(i), (SELECT count(*) AS n FROM embeddings) e)")
def thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.thin(fx.points(spark, sf_dir), 100, "loc_id").select("loc_id")


@query("tail", f"WITH {CHAIN} SELECT chain, iter, {r('value', 'value')} FROM (SELECT *, max(iter) OVER (PARTITION BY chain) AS n FROM chain) WHERE iter > n - 3")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.tail(fx.chains(spark, sf_dir), 3).select("chain", "iter", rounded("value", "value"))


@query("intercept", f"WITH {IRR}, x AS (SELECT unnest([1, 2, 3]) AS j, unnest([c1, CASE WHEN loc_id = 0 THEN 2.0 ELSE 1.0 END, 1.0]) AS v FROM irr) SELECT CAST(min(j) AS INTEGER) AS intercept FROM (SELECT j FROM x GROUP BY j HAVING min(v) = 1 AND max(v) = 1)")
def intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a covariate, one that is 1 but at one place, and one that is 1 at all."""
    near = F.when(F.col("loc_id") == 0, 2.0).otherwise(1.0)
    return moments.intercept(fx.covariates(spark, sf_dir).select("loc_id", F.array(F.col("x")[1], near, F.lit(1.0)).alias("x")))


@query("reorder", f"WITH {IRR} SELECT loc_id, CAST(row_number() OVER (ORDER BY loc_id) - 1 AS BIGINT) AS ord FROM irr")
def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit ranks, by ranges: no row is identified by its position."""
    return neighbors.ranked(fx.points(spark, sf_dir)).select("loc_id", F.col("ord").cast("long").alias("ord"))


@query("stride", "SELECT CAST(i AS BIGINT) AS at FROM range(0, 3 * (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings)) t(i)")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.points(spark, sf_dir).count()
    return spark.range(0, 3 * n, n).select(F.col("id").alias("at"))


# Neighbours and graphs.
KNN = f"WITH {IRR}, {nn(5)} SELECT node, parent, k, {r('d', 'd')} FROM nn"


@query("knn_ordered", KNN)
def knn_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.ordered_knn(fx.points(spark, sf_dir), 5).select("node", "parent", "k", rounded("d", "d"))


@query("knn_ordered_cells", KNN)
def knn_ordered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for many points, at any size."""
    return neighbors.ordered_knn_cells(fx.points(spark, sf_dir), 5).select("node", "parent", "k", rounded("d", "d"))


SPLIT = f"{IRR}, train AS (SELECT * FROM irr WHERE loc_id % 10 <> 0), fresh AS (SELECT * FROM irr WHERE loc_id % 10 = 0)"
KNN_NEW = f"WITH {SPLIT}, {nn(5, 'train', 'fresh')} SELECT node, parent, k, {r('d', 'd')} FROM nn"


@query("knn_predict", KNN_NEW)
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    return neighbors.knn(p.filter("loc_id % 10 != 0"), p.filter("loc_id % 10 = 0"), 5).select("node", "parent", "k", rounded("d", "d"))


@query("knn_predict_cells", KNN_NEW)
def knn_predict_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    return neighbors.knn(p.filter("loc_id % 10 != 0"), p.filter("loc_id % 10 = 0"), 5, small=0).select("node", "parent", "k", rounded("d", "d"))


@query("grid_check", f"WITH {GRID} SELECT count(DISTINCT gx) AS nx, count(DISTINCT gy) AS ny, count(DISTINCT (gx, gy)) AS n, count(DISTINCT gx) * count(DISTINCT gy) = count(DISTINCT (gx, gy)) AS gridded FROM grid")
def grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.grid(spark, sf_dir).select("loc_id", (F.col("gx") * 0.5).alias("x"), (F.col("gy") * 2.0).alias("y"))
    return neighbors.grid_check(g)


GRID_DAG = (
    f"{GRID}, st AS (SELECT dx, dy FROM range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE (dy < 0 OR (dy = 0 AND dx < 0))), "
    "dag AS MATERIALIZED (SELECT node, parent, k, dx, dy FROM (SELECT a.loc_id AS node, b.loc_id AS parent, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(row_number() OVER (PARTITION BY a.loc_id ORDER BY dx * dx + dy * dy, dy, dx) AS INTEGER) AS k "
    "FROM grid a CROSS JOIN st JOIN grid b ON b.gx = a.gx + dx AND b.gy = a.gy + dy) WHERE k <= 15)"
)


@query("grid_dag", f"WITH {GRID_DAG} SELECT * FROM dag")
def grid_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.grid_dag(fx.grid(spark, sf_dir), 15)


@query("grid_patterns", f"WITH {GRID_DAG}, p AS (SELECT node, string_agg(dx || ',' || dy, ';' ORDER BY k) AS pattern FROM dag GROUP BY node) SELECT pattern, count(*) AS nodes, min(node) AS exemplar FROM p GROUP BY pattern")
def grid_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.patterns_of(neighbors.grid_parents(fx.grid(spark, sf_dir), 15))


BLANKET = f"{IRR}, {nn(3)}, bl AS (SELECT node, parent AS member FROM nn UNION SELECT parent, node FROM nn UNION SELECT a.parent, b.parent FROM nn a JOIN nn b ON a.node = b.node AND a.parent <> b.parent)"


@query("blanket", f"WITH {BLANKET} SELECT node, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members FROM bl GROUP BY node")
def blanket(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = neighbors.blanket(neighbors.ordered_knn(fx.points(spark, sf_dir), 3))
    return b.select("node", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(
    "coloring",
    f"WITH RECURSIVE {BLANKET}, ids AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT node FROM bl)), "
    "nb AS MATERIALIZED (SELECT a.nth, any_value(a.n) AS n, list(b.nth) FILTER (WHERE b.nth < a.nth) AS earlier FROM ids a JOIN bl ON bl.node = a.node JOIN ids b ON b.node = bl.member GROUP BY a.nth), "
    "c(nth, cols) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT nb.nth, list_append(cols, list_min(list_filter(range(0, len(coalesce(earlier, [])) + 1), "
    "lambda k: NOT list_contains(list_transform(coalesce(earlier, []), lambda e: cols[e]), k)))) FROM c JOIN nb ON nb.nth = c.nth + 1) "
    "SELECT node, CAST(cols[ids.nth] AS INTEGER) AS color FROM ids, (SELECT cols FROM c ORDER BY nth DESC LIMIT 1)",
)
def coloring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy colours, in the order of nodes."""
    return neighbors.coloring(neighbors.blanket(neighbors.ordered_knn(fx.points(spark, sf_dir), 3)))


@query(
    "maxmin_order",
    f"WITH RECURSIVE {IRR}, p AS MATERIALIZED (SELECT list(loc_id ORDER BY loc_id) AS ids, list(x ORDER BY loc_id) AS xs, list(y ORDER BY loc_id) AS ys, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM irr), "
    "f AS (SELECT list_transform(range(1, n + 1), lambda i: -(pow(xs[i] - mx, 2) + pow(ys[i] - my, 2))) AS c FROM p), "
    "g AS (SELECT list_position(c, list_max(c)) AS pos FROM f), "
    "s(ord, pos, near) AS (SELECT 0, pos, list_transform(range(1, n + 1), lambda i: CASE WHEN i = pos THEN -1.0 ELSE pow(xs[i] - xs[pos], 2) + pow(ys[i] - ys[pos], 2) END) FROM g, p "
    "UNION ALL SELECT ord + 1, nxt, list_transform(range(1, n + 1), lambda i: CASE WHEN i = nxt OR near[i] < 0 THEN -1.0 ELSE least(near[i], pow(xs[i] - xs[nxt], 2) + pow(ys[i] - ys[nxt], 2)) END) "
    "FROM (SELECT ord, near, list_position(near, list_max(near)) AS nxt FROM s) t, p WHERE ord + 1 < n) "
    "SELECT ids[pos] AS loc_id, CAST(ord AS BIGINT) AS ord FROM s, p",
)
def maxmin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.max_min(fx.points(spark, sf_dir))


@query(
    "vecchia_dag_maxmin",
    ORACLES["maxmin_order"].replace(" SELECT ids[pos] AS loc_id, CAST(ord AS BIGINT) AS ord FROM s, p", ", o AS MATERIALIZED (SELECT ids[pos] AS id, ord FROM s, p), q AS MATERIALIZED (SELECT ord AS loc_id, x, y FROM o JOIN irr ON irr.loc_id = id), ")
    + f"{nn(5, 'q')} SELECT a.id AS node, b.id AS parent, k, {r('d', 'd')} FROM nn JOIN o a ON a.ord = nn.node JOIN o b ON b.ord = nn.parent",
)
def vecchia_dag_maxmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.vecchia_dag(fx.points(spark, sf_dir), 5).select("node", "parent", "k", rounded("d", "d"))


@query("pairs_in_range", f"WITH {IRR} SELECT a.loc_id AS s1, b.loc_id AS s2, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 'd')} FROM irr a JOIN irr b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05")
def pairs_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscov.pairs_in_range(fx.points(spark, sf_dir), 0.05).select("s1", "s2", rounded("d", "d"))


@query("coincident", f"WITH {IRR} SELECT a.loc_id AS a, b.loc_id AS b FROM irr a JOIN irr b ON a.x = b.x AND a.y = b.y")
def coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    return neighbors.coincident(p, p)


def _factors(spark: SparkSession, sf_dir: str, m: int = 2) -> DataFrame:
    p = fx.points(spark, sf_dir)
    return vecchia.factors(p, neighbors.ordered_knn(p, m), fx.THETAS)


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.outcomes(spark, sf_dir).select("outcome", "loc_id", F.col("y").alias("a"))


@query("vecchia_m2", f"WITH {V2} SELECT outcome, node, p1, p2, {r('h1', 'h1')}, {r('h2', 'h2')}, {r('sqrt(r2)', 'sqrt_r')} FROM fac")
def vecchia_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _factors(spark, sf_dir)
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    return f.select("outcome", "node", at("parents", 0).alias("p1"), at("parents", 1).alias("p2"), rounded(at("h", 0), "h1"), rounded(at("h", 1), "h2"), rounded("sqrt_r", "sqrt_r"))


@query("logdet", f"WITH {V2} SELECT outcome, {r('-2 * sum(ln(sqrt(r2)))', 'logdet')} FROM fac GROUP BY outcome")
def logdet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.log_determinant(_factors(spark, sf_dir)).select("outcome", rounded("logdet", "logdet"))


@query("h_entries", f"WITH {V2} SELECT outcome, i, j, {r('v', 'v')} FROM h")
def h_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.entries(_factors(spark, sf_dir)).select("outcome", "i", "j", rounded("v", "v"))


@query("whiten", f"WITH {V2}, {WHITE} SELECT outcome, loc_id, {r('v', 'v')} FROM v")
def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.times(vecchia.entries(_factors(spark, sf_dir)), _vector(spark, sf_dir)).select("outcome", "loc_id", rounded("v", "v"))


@query("ht_times", f"WITH {V2} SELECT h.outcome, h.j AS loc_id, {r('sum(h.v * o.y)', 'v')} FROM h JOIN obs o ON o.outcome = h.outcome AND o.loc_id = h.i GROUP BY h.outcome, h.j")
def ht_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.transposed_times(vecchia.entries(_factors(spark, sf_dir)), _vector(spark, sf_dir)).select("outcome", "loc_id", rounded("v", "v"))


IDENTITY = f"WITH {OBS} SELECT outcome, loc_id, {r('y', 'v')} FROM obs"


@query("h_solve_roundtrip", IDENTITY)
def h_solve_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H (H^-1 a) is a."""
    f = _factors(spark, sf_dir, 10).persist()
    x = vecchia.inverse_times(f, _vector(spark, sf_dir)).withColumnRenamed("v", "a")
    return vecchia.times(vecchia.entries(f), x).select("outcome", "loc_id", rounded("v", "v"))


@query("ht_solve_roundtrip", IDENTITY)
def ht_solve_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _factors(spark, sf_dir, 10).persist()
    x = vecchia.inverse_times(f, _vector(spark, sf_dir), transposed=True).withColumnRenamed("v", "a")
    return vecchia.transposed_times(vecchia.entries(f), x).select("outcome", "loc_id", rounded("v", "v"))


@query("h_colnorm", f"WITH {V2} SELECT outcome, j AS loc_id, {r('sum(v * v)', 'v')} FROM h GROUP BY outcome, j")
def h_colnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.column_norms(vecchia.entries(_factors(spark, sf_dir))).select("outcome", "loc_id", rounded("v", "v"))


@query("precision_coo", f"WITH {V2} SELECT a.outcome, a.j AS i, b.j, {r('sum(a.v * b.v)', 'v')} FROM h a JOIN h b ON a.outcome = b.outcome AND a.i = b.i GROUP BY a.outcome, a.j, b.j")
def precision_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.precision(vecchia.entries(_factors(spark, sf_dir))).select("outcome", "i", "j", rounded("v", "v"))


@query("blanket_products", f"WITH {V2} SELECT a.outcome AS r, b.outcome AS s, a.j AS i, b.j, {r('sum(a.v * b.v)', 'v')} FROM h a JOIN h b ON a.i = b.i AND a.outcome <= b.outcome GROUP BY a.outcome, b.outcome, a.j, b.j")
def blanket_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.cross_products(vecchia.entries(_factors(spark, sf_dir))).select("r", "s", "i", "j", rounded("v", "v"))


@query("logdens", f"WITH {V2}, {WHITE}, d AS (SELECT outcome, -2 * sum(ln(sqrt(r2))) AS ld FROM fac GROUP BY outcome), s AS (SELECT outcome, sum(v * v) AS ss FROM v GROUP BY outcome) SELECT outcome, {r('0.5 * (ld - ss)', 'logdens')} FROM d JOIN s USING (outcome)")
def logdens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.log_density(_factors(spark, sf_dir), _vector(spark, sf_dir)).select("outcome", rounded("logdens", "logdens"))


@query(
    "grid_shared_factors",
    f"WITH {GRID_DAG}, pts AS (SELECT loc_id, gx * 0.1 AS x, gy * 0.1 AS y FROM grid), nn AS (SELECT node, parent, k, 0.1 * sqrt(dx * dx + dy * dy) AS d FROM dag WHERE k <= 2), "
    f"{vecchia2((K.Theta(6.0),), 'pts')} SELECT outcome, node, {r('sqrt(r2)', 'sqrt_r')} FROM fac",
)
def grid_shared_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a grid, nodes whose parents lie alike share a factor: it is made for one of them and joined to the rest."""
    p = fx.grid(spark, sf_dir).select("loc_id", (F.col("gx") * 0.1).alias("x"), (F.col("gy") * 0.1).alias("y"))
    return vecchia.build(p, (K.Theta(6.0),), 2, order="grid").factors.select("outcome", "node", rounded("sqrt_r", "sqrt_r"))


@query("vecchia_dag_grid", f"WITH {GRID_DAG} SELECT node, parent, k, {r('sqrt(dx * dx * 0.25 + dy * dy * 4.0)', 'd')}, dx, dy FROM dag")
def vecchia_dag_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.grid(spark, sf_dir).select("loc_id", (F.col("gx") * 0.5).alias("x"), (F.col("gy") * 2.0).alias("y"))
    return neighbors.vecchia_dag(p, 15, "grid").select("node", "parent", "k", rounded("d", "d"), "dx", "dy")


# Moments.
GRAM = "gr AS (SELECT a.outcome AS i, b.outcome AS j, sum(a.v * b.v) AS g, count(*) AS n FROM v a JOIN v b ON a.loc_id = b.loc_id AND a.outcome <= b.outcome GROUP BY a.outcome, b.outcome)"


def _white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecchia.times(vecchia.entries(_factors(spark, sf_dir)), _vector(spark, sf_dir))


@query("gram_v", f"WITH {V2}, {WHITE}, {GRAM} SELECT i, j, {r('g', 'g')}, n FROM gr")
def gram_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.gram(_white(spark, sf_dir)).select("i", "j", rounded("g", "g"), "n")


@query("sigma_scale", f"WITH {V2}, {WHITE}, {GRAM} SELECT i, j, {r('g + CASE WHEN i = j THEN 1 ELSE 0 END', 'scale')}, n + 3 AS df FROM gr")
def sigma_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.sigma_scale(_white(spark, sf_dir), 3).select("i", "j", rounded("scale", "scale"), "df")


@query("sigma_vi", f"WITH {V2}, {WHITE}, {GRAM} SELECT i, j, {r('(g + CASE WHEN i = j THEN 1 ELSE 0 END) / (n - 1)', 'sigma')} FROM gr")
def sigma_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.sigma_vi(_white(spark, sf_dir)).select("i", "j", rounded("sigma", "sigma"))


@query("center", f"WITH {OBS} SELECT outcome, loc_id, {r('y - avg(y) OVER (PARTITION BY outcome)', 'w')} FROM obs")
def center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.centered(fx.outcomes(spark, sf_dir).withColumnRenamed("y", "w")).select("outcome", "loc_id", rounded("w", "w"))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.residual(fx.outcomes_missing(spark, sf_dir), fx.covariates(spark, sf_dir), BETA)


@query("sse", f"WITH {MISS}, {RES} SELECT outcome, count(e) AS n, {r('sum(e * e)', 'sse')}, {r('var_samp(e) * (count(e) - 1)', 'centered_sse')} FROM res GROUP BY outcome")
def sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.squares(_residuals(spark, sf_dir)).select("outcome", "n", rounded("sse", "sse"), rounded("centered_sse", "centered_sse"))


@query("noise_scale", f"WITH {MISS}, {RES} SELECT outcome, {r('2 + count(e) / 2', 'shape')}, {r('1 + sum(e * e) / 2', 'rate')}, {r('(1 + var_samp(e) * (count(e) - 1) / 2) / ((count(e) - 1) / 2 + 1)', 'vi')} FROM res GROUP BY outcome")
def noise_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.noise_scale(_residuals(spark, sf_dir)).select("outcome", rounded("shape", "shape"), rounded("rate", "rate"), rounded("vi", "vi"))


NOISE = {1: 0.02, 2: 0.03, 3: 0.05}


@query("gaussian_loglik", f"WITH {MISS}, {RES} SELECT {r('sum(-0.5 * (ln(2 * pi() * d) + e * e / d))', 'loglik')} FROM (SELECT e, CASE outcome WHEN 1 THEN 0.02 WHEN 2 THEN 0.03 ELSE 0.05 END AS d FROM res WHERE e IS NOT NULL)")
def gaussian_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.gaussian_loglik(_residuals(spark, sf_dir), NOISE).select(rounded("loglik", "loglik"))


HX = "hx AS MATERIALIZED (SELECT h.outcome, h.i AS loc_id, p, sum(h.v * CASE p WHEN 1 THEN 1.0 ELSE c1 END) AS v FROM h JOIN irr ON irr.loc_id = h.j CROSS JOIN (SELECT unnest([1, 2]) AS p) GROUP BY h.outcome, h.i, p)"


@query(
    "gls_equations",
    f"WITH {V2}, {WHITE}, {HX} SELECT a.outcome AS a, b.outcome AS b, a.p AS i, b.p AS j, {r('sum(a.v * b.v)', 'xx')}, {r('sum(a.v * v.v)', 'xy')} FROM hx a JOIN hx b ON a.loc_id = b.loc_id JOIN v ON v.loc_id = b.loc_id AND v.outcome = b.outcome GROUP BY ALL",
)
def gls_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = vecchia.entries(_factors(spark, sf_dir)).persist()
    hx = moments.whitened_design(h, fx.covariates(spark, sf_dir))
    return moments.normal_equations(hx, vecchia.times(h, _vector(spark, sf_dir))).select("a", "b", "i", "j", rounded("xx", "xx"), rounded("xy", "xy"))


# Transforms and densities.
@query("bounded_transform", f"WITH {IRR} SELECT loc_id, {r('ln((t - 0.3) / (200 - t))', 'line')}, {r('0.3 + 199.7 / (1 + exp(-ln((t - 0.3) / (200 - t))))', 'back')}, {r('ln((200 - t) * (t - 0.3))', 'jacobian')} FROM (SELECT loc_id, 1 + abs(x) * 100 AS t FROM irr)")
def bounded_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    p = fx.points(spark, sf_dir).select("loc_id", (1 + F.abs("x") * 100).alias("t"))
    line = tr.to_line_column(t, 0.3, 200.0)
    return p.select("loc_id", rounded(line, "line"), rounded(tr.from_line_column(line, 0.3, 200.0), "back"), rounded(tr.log_jacobian_column(t, 0.3, 200.0), "jacobian"))


@query(
    "log_densities",
    f"WITH {IRR}, p AS (SELECT loc_id, 0.05 + 0.9 * abs(x) / (1 + abs(x)) AS t FROM irr) SELECT loc_id, {r('-ln(t) - ln(0.5) - 0.5 * ln(2 * pi()) - pow(ln(t) - 0.1, 2) / 0.5', 'lognormal')}, "
    f"{r('3 * ln(2) - lgamma(3) + 2 * ln(t) - 2 * t', 'gamma')}, {r('2 * ln(1.5) - lgamma(2) - 3 * ln(t) - 1.5 / t', 'inverse_gamma')}, {r('lgamma(5.0) - lgamma(2.0) - lgamma(3.0) + ln(t) + 2 * ln(1 - t)', 'beta')}, {r('ln(1.7) - 1.7 * t', 'exponential')} FROM p",
)
def log_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    p = fx.points(spark, sf_dir).select("loc_id", (0.05 + 0.9 * F.abs("x") / (1 + F.abs("x"))).alias("t"))
    return p.select(
        "loc_id", rounded(tr.lognormal_logdens(t, 0.1, 0.5), "lognormal"), rounded(tr.gamma_logdens(t, 3, 2), "gamma"), rounded(tr.inverse_gamma_logdens(t, 2, 1.5), "inverse_gamma"),
        rounded(tr.beta_logdens(t, 2, 3), "beta"), rounded(tr.exponential_logdens(t, 1.7), "exponential"),
    )


# Draws.
ESS = (
    f"{CHAIN}, c AS (SELECT chain, iter, value - avg(value) OVER (PARTITION BY chain) AS x, count(*) OVER (PARTITION BY chain) AS n FROM chain), "
    "lag AS (SELECT a.chain, a.n, b.iter - a.iter AS k, sum(a.x * b.x) AS g FROM c a JOIN c b ON a.chain = b.chain AND b.iter >= a.iter GROUP BY a.chain, a.n, b.iter - a.iter), "
    "rho AS (SELECT chain, n, k, g / max(CASE WHEN k = 0 THEN g END) OVER (PARTITION BY chain) AS rho FROM lag), "
    "pr AS (SELECT chain, n, k // 2 AS t, sum(rho) AS p FROM rho WHERE k < 2 * (n // 2) GROUP BY chain, n, k // 2), "
    "mono AS (SELECT chain, n, sum(CASE WHEN p <= 0 THEN 1 ELSE 0 END) OVER w AS bad, min(p) OVER w AS p FROM pr WINDOW w AS (PARTITION BY chain ORDER BY t)), "
    "tau AS (SELECT chain, n, greatest(1, 2 * sum(CASE WHEN bad = 0 THEN p ELSE 0 END) - 1) AS tau FROM mono GROUP BY chain, n)"
)


@query("ess", f"WITH {ESS}, z AS (SELECT chain, count(*) AS n, max(value) - min(value) AS range FROM chain GROUP BY chain) SELECT z.chain, z.n, {r('CASE WHEN z.n < 4 OR range = 0 THEN CAST(z.n AS DOUBLE) ELSE least(z.n, z.n / tau) END', 'ess')} FROM z LEFT JOIN tau USING (chain)")
def ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.ess(fx.chains(spark, sf_dir)).select("chain", "n", rounded("ess", "ess"))


S = "s AS MATERIALIZED (SELECT vec_id AS iter, 1 + abs(CAST(embedding[1] AS DOUBLE)) AS a, CAST(embedding[2] AS DOUBLE) AS b, 1 + abs(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings)"
SG = f"{S}, g AS MATERIALIZED (SELECT CAST(iter AS INTEGER) AS iter, unnest([1, 1, 2, 2]) AS i, unnest([1, 2, 1, 2]) AS j, unnest([a * a, a * b, a * b, b * b + c * c]) AS value FROM s)"


@query("s_to_sigma", f"WITH {SG} SELECT iter, i, j, {r('value', 'value')} FROM g")
def s_to_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.gram_of_factor(fx.factor_draws(spark, sf_dir)).select("iter", "i", "j", rounded("value", "value"))


@query("s_to_q", f"WITH {S} SELECT CAST(iter AS INTEGER) AS iter, unnest([1, 1, 2, 2]) AS i, unnest([1, 2, 1, 2]) AS j, unnest([round((b * b + c * c) / (a * a * c * c), 6) + 0.0, round(-b / (a * c * c), 6) + 0.0, round(-b / (a * c * c), 6) + 0.0, round(1 / (c * c), 6) + 0.0]) AS value FROM s")
def s_to_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.inverse_of_gram(fx.factor_draws(spark, sf_dir)).select("iter", "i", "j", rounded("value", "value"))


@query("sigma_corr", f"WITH {SG} SELECT g.iter, g.i, g.j, {r('g.value / sqrt(p.value * q.value)', 'value')} FROM g JOIN g p ON p.iter = g.iter AND p.i = g.i AND p.j = g.i JOIN g q ON q.iter = g.iter AND q.i = g.j AND q.j = g.j")
def sigma_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.to_correlation(draws.gram_of_factor(fx.factor_draws(spark, sf_dir))).select("iter", "i", "j", rounded("value", "value"))


@query("sigma_identify", f"WITH {SG} SELECT iter, i, j, {r('value * sqrt((iter % 5 + i) * (iter % 5 + j))', 'value')} FROM g")
def sigma_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = draws.gram_of_factor(fx.factor_draws(spark, sf_dir))
    scale = sigma.select("chain", "iter", F.col("i").alias("outcome")).distinct().withColumn("value", (F.col("iter") % 5 + F.col("outcome")).cast("double"))
    return draws.identified(sigma, scale).select("iter", "i", "j", rounded("value", "value"))


@query("running_mean", f"WITH {CHAIN} SELECT chain, iter, round(avg(value) OVER (PARTITION BY chain ORDER BY iter ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS mean FROM chain")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.running_mean(fx.chains(spark, sf_dir)).select("chain", "iter", (F.round("mean", 9) + F.lit(0.0)).alias("mean"))


@query(
    "running_mean_decaying",
    f"WITH RECURSIVE {CHAIN}, a AS (SELECT chain, iter, value, CASE WHEN iter <= 4 THEN 1.0 ELSE pow(iter - 3, -0.65) END AS a FROM chain), m(chain, iter, mean) AS (SELECT chain, iter, value FROM a WHERE iter = 1 UNION ALL SELECT a.chain, a.iter, mean + a.a * (a.value - mean) FROM m JOIN a ON a.chain = m.chain AND a.iter = m.iter + 1) SELECT chain, iter, {r('mean', 'mean')} FROM m",
)
def running_mean_decaying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.running_mean(fx.chains(spark, sf_dir), burn=3).select("chain", "iter", rounded("mean", "mean"))


@query("beta_covariance", f"WITH {SG} SELECT a.i, a.j, b.i AS k, b.j AS l, {r('covar_samp(a.value, b.value)', 'cov')} FROM g a JOIN g b ON a.iter = b.iter GROUP BY a.i, a.j, b.i, b.j")
def beta_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.entry_covariance(draws.gram_of_factor(fx.factor_draws(spark, sf_dir))).select("i", "j", "k", "l", rounded("cov", "cov"))


# Cross-covariances. Lower factors are checked where each point has one parent, so that they are products along a path.
PATH = (
    "WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id AS loc_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), "
    + nn(1, "p") + ", " + vecchia2(fx.THETAS, "p") + ", l(outcome, s, t, v) AS (SELECT outcome, node, node, sqrt(r2) FROM fac UNION ALL SELECT l.outcome, f.node, l.t, f.h1 * l.v FROM l JOIN fac f ON f.outcome = l.outcome AND f.p1 = l.s)"
)


def _lower(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = fx.points(spark, sf_dir)
    return p, crosscov.lower(vecchia.factors(p, neighbors.ordered_knn(p, 1), fx.THETAS))


@query("lower_factor", f"{PATH} SELECT outcome, s, t, {r('v', 'v')} FROM l WHERE v <> 0")
def lower_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower(spark, sf_dir)[1].select("outcome", "s", "t", rounded("v", "v"))


SFACT = "f AS (SELECT a.outcome AS i, b.outcome AS j, sum(a.v * b.v) / (SELECT count(*) FROM p) AS value FROM l a JOIN l b ON a.s = b.s AND a.t = b.t AND b.outcome <= a.outcome GROUP BY a.outcome, b.outcome)"


@query("scaling_at_zero", f"{PATH}, {SFACT} SELECT i, j, {r('value', 'value')} FROM f")
def scaling_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscov.at_zero(_lower(spark, sf_dir)[1]).select("i", "j", rounded("value", "value"))


@query("scaling_at_zero_symmetric", f"{PATH}, {SFACT} SELECT i, j, {r('value', 'value')} FROM f UNION ALL SELECT j, i, {r('value', 'value')} FROM f WHERE i <> j")
def scaling_at_zero_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscov.symmetric(crosscov.at_zero(_lower(spark, sf_dir)[1])).select("i", "j", rounded("value", "value"))


@query(
    "sigma_times_scaling",
    f"{PATH}, {SFACT}, {SG.replace('s AS MATERIALIZED', 'sd AS MATERIALIZED').replace('FROM s)', 'FROM sd)')} SELECT g.iter, g.i, g.j, {r('g.value * f.value', 'value')} FROM g JOIN f ON f.i = greatest(g.i, g.j) AND f.j = least(g.i, g.j)",
)
def sigma_times_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    edges = neighbors.ordered_knn(p, 1).persist()
    sigma = draws.gram_of_factor(fx.factor_draws(spark, sf_dir))
    theta = spark.createDataFrame([(j, *t) for j, t in enumerate(fx.THETAS, 1)], "outcome int, phi double, sigmasq double, nu double, alpha double")
    theta = sigma.select("chain", "iter").distinct().crossJoin(F.broadcast(theta))  # a row for each outcome
    return crosscov.scaled_draws(sigma, theta, p, edges).select("iter", "i", "j", rounded("value", "value"))


@query(
    "fij_bins",
    f"{PATH}, c AS (SELECT a.s AS s1, b.s AS s2, sum(a.v * b.v) AS c FROM l a JOIN l b ON a.t = b.t WHERE a.outcome = 1 AND b.outcome = 2 GROUP BY a.s, b.s), "
    f"d AS (SELECT a.loc_id AS s1, b.loc_id AS s2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a CROSS JOIN p b), "
    f"e AS (SELECT CAST(least(floor(d / (0.5 / 20)), 19) AS INTEGER) AS bin, coalesce(c, 0) AS c FROM d LEFT JOIN c USING (s1, s2) WHERE d <= 0.5) SELECT bin, {r('(bin + 0.5) * (0.5 / 20)', 'mid')}, count(*) AS pairs, {r('avg(c)', 'value')} FROM e GROUP BY bin",
)
def fij_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    return crosscov.binned(p, neighbors.ordered_knn(p, 1), fx.THETAS, 1, 2, bins=20, most=0.5).select("bin", rounded("mid", "mid"), "pairs", rounded("value", "value"))


@query(
    "cross_correlation_reference",
    f"WITH {IRR}, q AS (SELECT a.loc_id AS x_id, b.loc_id AS y_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM irr a CROSS JOIN irr b) "
    f"SELECT x_id, y_id, 2 AS i, 2 AS j, {r(kernel('d', fx.THETAS[1]), 'value')} FROM q",
)
def cross_correlation_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one outcome at all places given all of them, which is its kernel. Two outcomes are tested against dense algebra."""
    p = fx.points(spark, sf_dir)
    return crosscov.pairwise(p, p, p, [(2, 2)], fx.THETAS).select("x_id", "y_id", "i", "j", rounded("value", "value"))


# Outcomes of three draws, whose decays differ, numbered on for SQL: 3 (iter - 1) + outcome.
THETA_DRAWS = tuple(t._replace(phi=t.phi + it) for it in range(3) for t in fx.THETAS)
PATH_DRAWS = PATH.replace(vecchia2(fx.THETAS, "p"), vecchia2(THETA_DRAWS, "p"))


def _theta_draws(spark: SparkSession) -> DataFrame:
    """Two draws of each theta, the second in a chain of its own."""
    rows = [(chain, k // 3 + 1, k % 3 + 1, *t) for chain in (1, 2) for k, t in enumerate(THETA_DRAWS)]
    return spark.createDataFrame(rows, "chain int, iter int, outcome int, phi double, sigmasq double, nu double, alpha double")


@query(
    "fij_at_zero_draws",
    f"{PATH_DRAWS}, f AS (SELECT (a.outcome + 2) // 3 AS iter, (a.outcome - 1) % 3 + 1 AS i, (b.outcome - 1) % 3 + 1 AS j, sum(a.v * b.v) / (SELECT count(*) FROM p) AS value FROM l a JOIN l b ON a.s = b.s AND a.t = b.t AND b.outcome <= a.outcome AND (a.outcome + 2) // 3 = (b.outcome + 2) // 3 GROUP BY a.outcome, b.outcome) "
    f"SELECT CAST(chain AS INTEGER) AS chain, CAST(iter AS INTEGER) AS iter, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('value', 'value')} FROM f CROSS JOIN range(1, 3) t(chain)",
)
def fij_at_zero_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors at zero by draw; equal thetas are computed once."""
    p = fx.points(spark, sf_dir)
    return crosscov.zero_draws(p, neighbors.ordered_knn(p, 1), _theta_draws(spark)).select("chain", "iter", "i", "j", rounded("value", "value"))


@query(
    "fij_bins_draws",
    f"{PATH_DRAWS}, c AS (SELECT (a.outcome + 2) // 3 AS iter, a.s AS s1, b.s AS s2, sum(a.v * b.v) AS c FROM l a JOIN l b ON a.t = b.t WHERE a.outcome % 3 = 1 AND b.outcome = a.outcome + 1 GROUP BY a.outcome, a.s, b.s), "
    "d AS (SELECT iter, a.loc_id AS s1, b.loc_id AS s2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a CROSS JOIN p b CROSS JOIN range(1, 4) t(iter)), "
    f"e AS (SELECT iter, CAST(least(floor(d / (0.5 / 20)), 19) AS INTEGER) AS bin, coalesce(c, 0) AS c FROM d LEFT JOIN c USING (iter, s1, s2) WHERE d <= 0.5) "
    f"SELECT CAST(chain AS INTEGER) AS chain, CAST(iter AS INTEGER) AS iter, bin, {r('(bin + 0.5) * (0.5 / 20)', 'mid')}, count(*) AS pairs, {r('avg(c)', 'value')} FROM e CROSS JOIN range(1, 3) u(chain) GROUP BY chain, iter, bin",
)
def fij_bins_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.points(spark, sf_dir)
    out = crosscov.binned_draws(p, neighbors.ordered_knn(p, 1), _theta_draws(spark), 1, 2, bins=20, most=0.5)
    return out.select("chain", "iter", "bin", rounded("mid", "mid"), "pairs", rounded("value", "value"))

"""Locations, observations, design: their schemas, reading and checking; draws: their writing.

locations(loc_id long, x double, y double); obs(loc_id long, outcome int, y double or null);
design(loc_id long, x array<double>); draws(chain, iter, param, i, j, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATIONS = T.StructType([T.StructField("loc_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
DRAWS = "chain int, iter int, param string, i int, j int, value double"


def read(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """A table of any format that Spark reads; columns are pruned and filters pushed down by what is selected later."""
    return spark.read.format(format).options(**options).load(path)


def locations(table: DataFrame, loc_id: str, x: str, y: str) -> DataFrame:
    """Any table as locations; coordinates may be expressions."""
    return table.select(F.expr(loc_id).cast("long").alias("loc_id"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))


def observations(table: DataFrame, loc_id: str, outcomes: list[str]) -> DataFrame:
    """Outcomes from columns or expressions, one row each: NaN is missing, and so is null; infinity is refused later."""
    each = F.array(*(F.struct(F.lit(j).alias("outcome"), F.expr(y).cast("double").alias("y")) for j, y in enumerate(outcomes, 1)))
    rows = table.select(F.expr(loc_id).cast("long").alias("loc_id"), F.explode(each).alias("o"))
    return rows.select("loc_id", "o.outcome", F.when(F.isnan("o.y"), None).otherwise(F.col("o.y")).alias("y"))


def design(table: DataFrame, loc_id: str, covariates: list[str]) -> DataFrame:
    return table.select(F.expr(loc_id).cast("long").alias("loc_id"), F.array(*(F.expr(c).cast("double") for c in covariates)).alias("x"))


def faults(locs: DataFrame, obs: DataFrame, design_: DataFrame) -> DataFrame:
    """One row of counts, all 0 for tables that a model can be fitted to: duplicate places and ids, values not finite, rows without a location."""
    bad = lambda c: F.sum(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0))
    place = locs.groupBy("x", "y").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("same_place"))
    ids = locs.groupBy("loc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("same_id"))
    finite = locs.agg(F.coalesce(bad("x") + bad("y"), F.lit(0)).cast("long").alias("bad_place"))
    infinite = obs.agg(F.coalesce(F.sum((F.abs("y") == float("inf")).cast("long")), F.lit(0)).cast("long").alias("bad_outcome"))
    covariate = design_.agg(F.coalesce(F.sum(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("long")), F.lit(0)).cast("long").alias("bad_covariate"))
    lost = obs.join(locs, "loc_id", "left_anti").agg(F.count("*").alias("lost"))
    return place.crossJoin(ids).crossJoin(finite).crossJoin(infinite).crossJoin(covariate).crossJoin(lost)  # six single rows


def check(locs: DataFrame, obs: DataFrame, design_: DataFrame) -> None:
    found = {k: n for k, n in faults(locs, obs, design_).first().asDict().items() if n}
    if found:
        raise ValueError(f"the tables can't be fitted: {found}")


def write_draws(draws: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Draws as Parquet, one folder for each parameter."""
    draws.write.mode(mode).partitionBy("param").parquet(path)


def read_draws(spark: SparkSession, path: str, param: str | None = None) -> DataFrame:
    """Draws back, of one parameter only if it is named: other folders are not read."""
    draws = spark.read.parquet(path).select("chain", "iter", "param", "i", "j", "value")
    return draws.filter(F.col("param") == param) if param else draws

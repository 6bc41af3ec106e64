"""Spatial tables made from the general tables of a test directory, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta
from terrane.sources import tables

# Parameters of three outcomes (decay, variance, smoothness, nugget share), and their covariance.
THETAS = (Theta(6.0, 1.0, 0.5, 0.0), Theta(9.0, 1.0, 1.5, 0.1), Theta(12.0, 1.0, 2.5, 0.2))
SIGMA = ((1.0, 0.5, 0.5), (0.5, 1.0, 0.5), (0.5, 0.5, 1.0))
OUTCOMES = ("embedding[2]", "embedding[3]", "embedding[4]")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular locations."""
    return tables.locations(raw(spark, sf_dir, "embeddings"), "vec_id", "embedding[0]", "embedding[1]")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.observations(raw(spark, sf_dir, "embeddings"), "vec_id", list(OUTCOMES))


def outcomes_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes, some of them missing."""
    gone = (F.col("loc_id") * 7 + F.col("outcome")) % 11 == 0
    return outcomes(spark, sf_dir).withColumn("y", F.when(~gone, F.col("y")))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intercept and one covariate."""
    return tables.design(raw(spark, sf_dir, "embeddings"), "vec_id", ["1.0D", "embedding[5]"])


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full rectangle 50 wide: loc_id, gx, gy, z."""
    c = raw(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("loc_id"), (F.col("c_custkey") % 50).cast("int").alias("gx"), F.floor(F.col("c_custkey") / 50).cast("int").alias("gy"), F.col("c_acctbal").cast("double").alias("z"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws: a chain for each user, its values in the order of time."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("int")
    return raw(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("chain"), nth.alias("iter"), F.lit("value").alias("param"), F.lit(1).alias("i"), F.lit(1).alias("j"), F.col("value").cast("double").alias("value"))


def factor_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of upper triangular 2 x 2 factors, one for each vector: chain 0, diagonals positive."""
    e = raw(spark, sf_dir, "embeddings")
    v = lambda k: F.col("embedding")[k].cast("double")
    cells = F.array(
        F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), (1 + F.abs(v(0))).alias("value")),
        F.struct(F.lit(1).alias("i"), F.lit(2).alias("j"), v(1).alias("value")),
        F.struct(F.lit(2).alias("i"), F.lit(2).alias("j"), (1 + F.abs(v(2))).alias("value")),
    )
    return e.select(F.lit(0).alias("chain"), F.col("vec_id").cast("int").alias("iter"), F.explode(cells).alias("c")).select("chain", "iter", F.lit("S").alias("param"), "c.i", "c.j", "c.value")

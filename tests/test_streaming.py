import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrane.functions.kernels import Theta
from terrane.models import predict
from terrane.streaming.predictions import predict_stream, predictions


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(60), "x": rng.random(60), "y": rng.random(60)})).persist()
    train, new = points.filter("loc_id < 45"), points.filter("loc_id >= 45")
    obs = train.select("loc_id", F.lit(1).alias("outcome"), F.sin("x").alias("y"))
    design = points.select("loc_id", F.array(F.lit(1.0)).alias("x"))
    draws = [predict.Draw(np.array([[0.1]]), np.array([[0.5]]), (Theta(6.0),))] * 3
    for part in range(3):
        new.filter(f"loc_id % 3 = {part}").withColumn("covariates", F.array(F.lit(1.0))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("loc_id bigint, x double, y double, covariates array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = predict_stream(stream, train, obs, design, draws, str(tmp_path / "out"), str(tmp_path / "check"), m=5, available_now=True)
    query.awaitTermination(120)
    got = predictions(spark, str(tmp_path / "out")).select("loc_id", "draw", "outcome", "value").orderBy("loc_id", "draw").toPandas()
    want = predict.response(train, obs, design, new, design, draws, 5).orderBy("loc_id", "draw").toPandas()
    assert len(got) == 45 and np.allclose(got["value"], want["value"])


def test_partly_observed_places(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame(pd.DataFrame({"loc_id": np.arange(30), "x": rng.random(30), "y": rng.random(30)})).persist()
    obs = points.select("loc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("outcome"), F.cos("x").alias("y"))
    design = points.select("loc_id", F.array(F.lit(1.0)).alias("x"))
    draw = predict.Draw(np.zeros((1, 2)), np.array([[1.0, 0.8], [0.8, 1.0]]), (Theta(6.0), Theta(9.0)))
    train, new = points.filter("loc_id < 20"), points.filter("loc_id >= 20")
    known = spark.createDataFrame([(20, 1, 5.0), (21, 1, 5.0), (21, 2, 6.0), (22, 2, None)], "loc_id bigint, outcome int, y double")
    got = {(r["loc_id"], r["outcome"]): r["value"] for r in predict.response(train, obs, design, new, design, [draw], 6, partly=known, noise=False).collect()}
    plain = {(r["loc_id"], r["outcome"]): r["value"] for r in predict.response(train, obs, design, new, design, [draw], 6, noise=False).collect()}
    assert got[20, 1] == 5.0 and got[20, 2] > plain[20, 2]
    assert (got[21, 1], got[21, 2]) == (5.0, 6.0)
    assert got[22, 1] == plain[22, 1] and got[25, 2] == plain[25, 2]

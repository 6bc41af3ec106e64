"""Stream-static prediction: a new place depends on training data only, so each micro-batch is predicted by itself.

No state is kept and late places need no care. Each batch goes to a folder of its own, named by its number and
overwritten if Spark repeats the batch, so that results are there once; random numbers are keyed by seed, draw
and place, so a repeated batch gives the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrane.models import predict


def predict_stream(
    new: DataFrame, train: DataFrame, obs: DataFrame, design: DataFrame, draws: Sequence[predict.Draw], path: str, checkpoint: str, *, m: int = 15, family: int = 1, seed: int = 1, available_now: bool = False,
) -> StreamingQuery:
    """Starts predicting the places of a stream (loc_id, x, y, covariates array<double>) into path/batch=N."""

    def batch(places: DataFrame, number: int) -> None:
        places = places.persist()
        design_new = places.select("loc_id", places["covariates"].alias("x"))
        out = predict.response(train, obs, design, places.select("loc_id", "x", "y"), design_new, draws, m, family, seed)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        places.unpersist()

    writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """What has been predicted so far: loc_id, draw, outcome, value, batch."""
    return spark.read.parquet(path)

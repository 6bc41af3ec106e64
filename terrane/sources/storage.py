"""Where results are kept that are computed once: folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none: one of its own in local mode, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written there to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def kept(df: DataFrame, folder: str) -> DataFrame:
    """df as Parquet in the folder: written, unless it is there already, and read."""
    if not complete(df.sparkSession, folder):
        df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def once(df: DataFrame, name: str) -> DataFrame:
    """df, computed now, as Parquet in a new folder."""
    return kept(df, new_folder(df.sparkSession, name))

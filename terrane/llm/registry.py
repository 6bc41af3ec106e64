"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, bestfit, clustering, knn, langid, lexical, mixing, neardup, packing, pii, secrets, sharding, tokencount

MODULES = (pii, secrets, mixing, packing, langid, tokencount, neardup, knn, ann, sharding, lexical, clustering, bestfit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.ORACLES.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

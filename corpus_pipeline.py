"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes what its predecessor kept and returns the same columns; the last returns the pieces of packed
sequences. Null ids, texts and sources pass through as the operators' docstrings say; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import langid, mixing, neardup, packing, secrets
from terrane.llm.shared import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and percent of similarity at which documents are near-duplicates.
SHINGLE, SIMILAR = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is surely one of those learnt; a missing label is filled in."""
    found = langid.predict(docs, langid.learn(docs), keep=COLUMNS)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= langid.ACCEPT))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of rows with one id, the one with the least text. Rows without an id stay."""
    kept = neardup.dedup(docs, SHINGLE, SIMILAR).filter("kept and doc_id is not null").select("doc_id").distinct()
    rest = F.struct(*(c for c in COLUMNS if c != "doc_id"))
    one = docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("row"))
    return one.select("doc_id", "row.*").unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    found, _ = secrets.scan(docs, keep=COLUMNS)
    clean = secrets.redact(F.col("text"), F.col("spans"))
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length(clean)).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; a row for each time."""
    rows = mixing.mix(docs, keep=("text", "lang", "n_chars"), split_last=False)
    times = (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(True), times))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("op5_language_id", language_id),
    ("op7_near_dedup", near_dedup),
    ("op2_secrets", secret_scan),
    ("op3_mixing", source_mix),
    ("op4_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents, each stored as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

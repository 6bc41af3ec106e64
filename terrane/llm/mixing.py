"""Mixing sources to target weights by capped water-filling.

Each source has a weight. All sources together take as many words as the corpus has; a source is clamped
at CAP epochs, and what it cannot take goes to the others by weight. The level of the water is found
in one pass over the sources in order of cap per weight: a source is clamped if all sources, filled to
the level at which it is full, need no more than there is.

A source's documents are taken a whole number of times, and once more for those that come first in a
seeded order until the rest of the target is met. The order is by MD5 of seed and id; its first digits
cut a source into bins, so a source with a third of all rows is ordered by many tasks. A bin that holds far more rows than its
share, one id or none standing in very many, is cut again, by row numbers. Sources themselves are ranked
and summed up in ranges, so there may be as many as there are rows. Native throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, durable, table

CAP = 3
SEED = "mix-1"
#: Hexadecimal digits of the order that make a bin: 16 ** 3 bins for each source.
BIN_DIGITS = 3
#: A bin is cut again if it has more rows than this, than HOT times its share of the source, and than one in MOST_CUT of all rows: MOST_CUT bins at most are.
PART_ROWS, HOT, MOST_CUT = 4096, 4, 1 << 16


def ahead(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name of sums, the total of that column over all rows before, in that order, which has no ties.

    Ranges are summed up each by a task, and then the ranges' totals, one row for each task.
    """
    parts = durable(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(*(F.sum(c).alias(f"{n}_all") for n, c in sums.items()))
    totals = totals.select("part", *(F.coalesce(F.sum(f"{n}_all").over(earlier), F.lit(0)).alias(f"{n}_all") for n in sums))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}_own") for n, c in sums.items()))
    return parts.join(F.broadcast(totals), "part").select(*rows.columns, *((F.col(f"{n}_all") + F.col(f"{n}_own")).alias(n) for n in sums))


def fill(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (source, nth long, weight long, size long), with target double, as well as whole long and rest long.

    whole: how often all of the source is taken; rest: the words taken beyond that. nth tells sources apart.
    Sums are exact (decimals, and integers of the driver, which gets two rows of totals).
    """
    total, weights_ = (x or 0 for x in sources.agg(F.sum("size"), F.sum("weight")).first())
    most, w = (F.col("size") * cap).cast("decimal(38,0)"), F.col("weight").cast("decimal(20,0)")
    ratio = (F.col("size") * cap).cast("double") / F.col("weight")
    wide = ahead(sources, [ratio.asc(), F.col("nth").asc()], {"most_before": most, "w_before": w})
    full = F.col("most_before") * w + most * (F.lit(weights_) - F.col("w_before")) <= F.lit(total).cast("decimal(38,0)") * w
    wide = durable(wide.withColumn("clamped", full))
    shut_words, shut_weight = (int(x or 0) for x in wide.filter("clamped").agg(F.sum(most), F.sum(w)).first())
    share = (F.col("weight") * F.lit(total - shut_words)).cast("double") / F.lit(float(weights_ - shut_weight))
    target = F.when(F.col("clamped"), most.cast("double")).otherwise(F.least(share, most.cast("double")))
    wide = wide.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("words") / F.col("size")), F.lit(cap))).otherwise(0).cast("long")
    return wide.withColumn("whole", whole).withColumn("rest", F.least(F.col("words") - F.col("whole") * F.col("size"), F.col("size"))).select(
        *sources.columns, "target", "whole", "rest"
    )


def weights(names: DataFrame) -> DataFrame:
    """names (source, size): weights 1, 2, 3, repeating, by code point of the name, null last."""
    numbered = ahead(names, [F.col("source").asc_nulls_last()], {"nth": F.lit(1).cast("long")})
    return numbered.select("source", "size", "nth", (F.col("nth") % 3 + 1).cast("long").alias("weight"))


def cut(rows: DataFrame, bins: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (source, bin, size, row) with part, 0 but in bins that are cut, and bins (source, bin, part, bin_size) to match."""
    whole = rows.withColumn("part", F.lit(0).cast("bigint")), bins.withColumn("part", F.lit(0).cast("bigint"))
    if bins.filter(F.col("n") > PART_ROWS).isEmpty():
        return whole
    total = names.agg(F.sum("rows")).first()[0] or 0
    shares = names.select(F.col("source").alias("of"), (HOT * F.col("rows") / 16**BIN_DIGITS).alias("share"))
    hot = bins.join(shares, bins["source"].eqNullSafe(shares["of"])).filter((F.col("n") > max(PART_ROWS, total // MOST_CUT)) & (F.col("n") > F.col("share")))
    large = hot.select("source", "bin", F.ceil(F.col("n") / PART_ROWS).alias("parts")).collect()  # MOST_CUT rows at most
    if not large:
        return whole
    kind = bins.schema["source"].dataType.simpleString()
    told = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in large], f"cut_source {kind}, cut_bin string, parts bigint"))
    parted = rows.join(told, rows["source"].eqNullSafe(told["cut_source"]) & (rows["bin"] == told["cut_bin"]), "left")
    parted = parted.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).select(*rows.columns, "part")
    return parted, parted.groupBy("source", "bin", "part").agg(F.sum("size").alias("bin_size"))


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED, keep: tuple[str, ...] = (), split_last: bool = True) -> DataFrame:
    """What the mix takes of every row of docs (doc_id, text, source).

    Columns: doc_id, size, source, source_size, target, whole (times the whole source is taken), extra (words
    of the row taken once more), and those named in keep. With split_last the row at the end of a source's
    rest gives only the words that are still due, and each target is met to one word; without it that row is
    taken whole if at least half of it is due. taken = whole * size + extra.

    Null text: no words. Null source: a source of its own, last. Repeated rows, also of one id: each is taken
    by itself, in any order among alike ones. No rows: no rows. Columns not named are ignored. Where an id, or null, stands in so many
    rows that their bin is cut, the bin's order is by parts of row numbers first: reruns agree as long as docs has the same partitions.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        mark.alias("mark"),
        *keep,
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("bin", F.substring("mark", 1, BIN_DIGITS))
    slim = durable(rows.select("doc_id", "source", "size", "mark", "bin", "row")) if not keep else rows
    bins = durable(slim.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("n")))
    names = bins.groupBy("source").agg(F.sum("bin_size").alias("size"), F.sum("n").alias("rows"))
    slim, bins = cut(slim, bins, names)
    plan = durable(fill(weights(names.select("source", "size")), cap)).select("source", F.col("size").alias("source_size"), "target", "whole", "rest")
    before = Window.partitionBy("source").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("ahead", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    bins = bins.join(plan, bins["source"].eqNullSafe(plan["source"])).select(
        bins["source"].alias("bin_source"), F.col("bin").alias("bin_at"), F.col("part").alias("part_at"), "ahead", "source_size", "target", "whole", "rest"
    )
    order = Window.partitionBy("source", "bin", "part").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("in_bin", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(bins, rows["source"].eqNullSafe(bins["bin_source"]) & (rows["bin"] == bins["bin_at"]) & (rows["part"] == bins["part_at"]))
    due = F.col("rest") - F.col("ahead") - F.col("in_bin")
    extra: Column = F.least(F.greatest(due, F.lit(0)), F.col("size"))
    if not split_last:
        extra = F.when(extra * 2 >= F.col("size"), F.col("size")).otherwise(0)
    return rows.select("doc_id", "size", "source", "source_size", "target", "whole", extra.cast("long").alias("extra"), *keep)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken)


QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {
    "op3_mixing": f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS most,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
lv AS (SELECT a.source, a.most, a.w, sum(CASE WHEN b.most * a.w <= a.most * b.w THEN b.most * a.w ELSE a.most * b.w END) AS need,
              (SELECT sum(source_size) FROM s) * a.w AS have
       FROM s a CROSS JOIN s b GROUP BY a.source, a.most, a.w),
c AS (SELECT sum(CASE WHEN need <= have THEN most ELSE 0 END) AS shut, sum(CASE WHEN need <= have THEN 0 ELSE w END) AS open_w FROM lv),
p AS (SELECT s.source, s.source_size,
             CASE WHEN lv.need <= lv.have THEN CAST(s.most AS DOUBLE)
                  ELSE least(CAST(s.w * ((SELECT sum(source_size) FROM s) - c.shut) AS DOUBLE) / CAST(c.open_w AS DOUBLE), CAST(s.most AS DOUBLE)) END AS target
      FROM s JOIN lv ON s.source IS NOT DISTINCT FROM lv.source CROSS JOIN c),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(words // source_size, 3) ELSE 0 END AS whole FROM q),
o AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, least(r.words - r.whole * r.source_size, r.source_size) AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(greatest(rest - ahead, 0), size) AS BIGINT) AS taken FROM o
""",
}

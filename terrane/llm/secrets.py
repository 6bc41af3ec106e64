"""Secret scans over an incremental ledger of blobs.

Each version of a document is a blob, named by the SHA-256 of its text. The ledger holds, for each blob and
version of a rule that has been scanned, the spans found. A scan takes one row of each blob for which a
rule is missing from the ledger, runs those rules only, and joins the findings back to all rows of the blob.

Native throughout. Positions come from the pieces between matches and the matches themselves, their lengths
summed up in order; a text with matches has a row for each of them meanwhile, so nothing is quadratic in a text.
Copies of a blob beyond one are known by hash alone and never scanned; a blob with a third of all rows is
found once, by a minimum that is taken before the shuffle, and its rows meet the findings in a join that
adaptive execution can split.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import durable, screened, spans_text, table


class Rule(NamedTuple):
    """kind, version, pattern; least: shortest match kept, or shortest group if that is not 0."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The rules of the contract in its order, then those that this method adds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN, 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
)
PEM_MARK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
# A key through its END line, or without one through the header and base64 lines that follow, line ends written out
# as \\n too. Possessive, so that each mark is followed at most to the next and no loop needs a stack.
PEM = (
    PEM_MARK
    + r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    + r"|(?:(?:[\x20\t\r\n]|\\[nrt])++(?:[A-Za-z][A-Za-z-]{1,39}:\x20[^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++(?:={1,2}+|(?=[\x20\t]*+(?![^\r\n\\])))))*+)"
)
ADDED_RULES = (
    Rule("pem", 2, PEM, 1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", 1, r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("stripe", 1, r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 24),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
)
RULES = BASE_RULES + ADDED_RULES
#: Rows of a blob up to which it is taken as it is: so many, or one in COMMON of all rows.
COPIES, COMMON = 256, 1 << 16
SPANS = "array<struct<at: bigint, kind: string, upto: bigint>>"
LEDGER = f"blob_id string, rule string, spans {SPANS}"


def lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x).cast("long"))


def hits(rule: Rule) -> Column:
    """A struct (rule, kind, hits) where the rule matches; hits: length of the gap before, of the match, of its group."""
    p = F.lit(rule.pattern)
    gaps, found = lengths(F.split("text", rule.pattern, -1)), lengths(F.regexp_extract_all("text", p, F.lit(0)))
    told = lengths(F.regexp_extract_all("text", p, F.lit(rule.group))) if rule.group else found
    every = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("own"), told.alias("told"))
    named = F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).cast("long").alias("least"), every.alias("hits"))
    return F.when(F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern), named)


def find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs (blob_id, todo, text), todo naming the rules to run: (blob_id, rule, kind, at, upto), a row a span."""
    named = F.filter(F.array(*(hits(r) for r in rules)), lambda x: x.isNotNull())
    by_rule = blobs.select("blob_id", F.explode(named).alias("r"))
    each = by_rule.select("blob_id", "r.rule", "r.kind", "r.least", F.posexplode("r.hits").alias("nth", "h"))
    so_far = Window.partitionBy("blob_id", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("blob_id", "rule", "kind", F.sum(F.col("h.gap") + F.col("h.own")).over(so_far).alias("upto"), "h.own", "h.told", "least")
    return placed.filter("told >= least").select("blob_id", "rule", "kind", (F.col("upto") - F.col("own")).alias("at"), "upto")


def ranked(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of a ledger, by start, then by the rules' order today: array of (at, rank, kind, upto)."""
    kinds = dict.fromkeys(r.kind for r in rules)  # versions of a kind share its place
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["upto"].alias("upto"))))


def one_row_each(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row of each of the blobs (blob_id, path, n, todo), n being their rows: blob_id, todo, text.

    Rows are met by (blob_id, path). Very many rows of a blob may share a path, if they have one id or none; so rows of blobs with
    very many are first reduced to one where they are. Such blobs are COMMON at most, and broadcast.
    """
    total = blobs.agg(F.sum("n")).first()[0] or 0
    most = max(COPIES, total // COMMON)
    common = [r["blob_id"] for r in blobs.filter(F.col("n") > most).select("blob_id").collect()]  # COMMON rows at most
    one = blobs.filter(F.col("n") <= most).select(F.col("blob_id").alias("b"), F.col("path").alias("p"), "todo").hint("shuffle_hash")
    chosen = rows.join(one, (rows["blob_id"] == one["b"]) & (rows["path"] == one["p"])).select("blob_id", "path", "todo", "text")
    chosen = chosen.dropDuplicates(["blob_id", "path"]).select("blob_id", "todo", "text")  # one path a blob: dealt as the join is
    if not common:
        return chosen
    named = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in common], "b string"))
    few = rows.join(named, rows["blob_id"] == named["b"], "left_semi").groupBy("blob_id").agg(F.min("text").alias("text"))  # one text a blob
    return chosen.unionByName(few.join(blobs.select("blob_id", "todo"), "blob_id").select("blob_id", "todo", "text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of docs (doc_id, text), and the ledger's new rows (blob_id, rule, spans).

    Findings: doc_id, blob_id, spans (at, rank, kind, upto; by start, then rule), and the columns named in keep. New ledger
    rows: one for each blob and rule that was not in the ledger, spans (at, kind, upto) null if nothing was found; append
    them to it. A ledger knows rules by kind and version only, so rules may be added, raised and put in another order.

    Null text: as empty. Repeated rows and null ids: a row each. No rows: none, and no new ledger rows. Columns
    not named are ignored. A ledger that names a blob and rule twice counts once. Texts whose blobs are all in the ledger
    are hashed where they are, and neither moved nor scanned.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    # A hash of the id, so that null ids are as others. Rows that share it within a blob have one text.
    rows = docs.select(F.xxhash64("doc_id").alias("path"), text).withColumn("blob_id", F.sha2("text", 256))
    blobs = rows.groupBy("blob_id").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        blobs = blobs.withColumn("todo", keys)
    else:
        done = ledger.groupBy(F.col("blob_id").alias("seen_id")).agg(F.collect_set("rule").alias("seen"))  # at most one entry a rule version
        blobs = blobs.join(done, blobs["blob_id"] == done["seen_id"], "left")
        blobs = blobs.select("blob_id", "path", "n", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    blobs = durable(blobs.filter(F.size("todo") > 0))
    chosen = one_row_each(rows if ledger is None else screened(rows, "blob_id", blobs.select("blob_id")), blobs)
    span = F.struct("at", "kind", "upto")
    keyed = durable(find(chosen, rules).groupBy("blob_id", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans")))
    todo = blobs.select("blob_id", F.explode("todo").alias("rule"))
    new = todo.join(keyed, ["blob_id", "rule"], "left").select("blob_id", "rule", F.col("spans").cast(SPANS).alias("spans"))
    known = keyed if ledger is None else keyed.unionByName(ledger.filter(F.col("rule").isin([r.key for r in rules]) & F.col("spans").isNotNull()).select("blob_id", "rule", F.col("spans").cast(SPANS).alias("spans")).dropDuplicates(["blob_id", "rule"]))
    # Cut off, so that a blob of very many rows meets its findings in a join that can be split.
    by_blob = durable(known.groupBy(F.col("blob_id").alias("found_id")).agg(ranked(F.flatten(F.collect_list("spans")), rules).alias("spans")))
    paths = docs.select("doc_id", F.sha2(text, 256).alias("blob_id"), *(c for c in keep if c not in ("doc_id", "blob_id")))
    empty = F.array().cast(by_blob.schema["spans"].dataType)
    found = paths.join(by_blob, paths["blob_id"] == by_blob["found_id"], "left").select("doc_id", "blob_id", F.coalesce("spans", empty).alias("spans"), *(c for c in keep if c != "doc_id"))
    return found, new


def scan_with_ledger(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The findings of scan(), with the ledger in a folder as Parquet: read if it is there, and appended to.

    Run it again over a grown corpus, or with a rule's version raised, and only what is new is scanned. One writer at a
    time; rows that were appended twice count once.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    found, new = scan(docs, spark.read.schema(LEDGER).parquet(folder) if known else None, rules, keep)
    new.write.mode("append").parquet(folder)
    return found


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each stretch that spans cover replaced by mark; null where text is null."""
    start = F.struct(F.lit(1).cast("long").alias("next"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["at"] + 1 >= acc["next"]
        piece = F.when(apart & (s["upto"] > 0), F.array(F.substr(text, acc["next"], s["at"] + 1 - acc["next"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["next"], s["upto"] + 1).alias("next"), F.concat(acc["out"], piece).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["next"], F.length(text).cast("long")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.rank < 3)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def _oracle() -> str:
    """The spans in SQL. Of a PEM key it knows the first line only: its patterns can not look ahead. The test tables have no such keys."""
    parts = []
    for rank, r in enumerate(RULES):
        p = (PEM_MARK if r.kind == "pem" else r.pattern).replace("'", "''")
        told = f"list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x))"
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)) AS own, {told} AS told FROM d WHERE regexp_matches(text, '{p}')"
        )
    base = "FILTER (WHERE rank < 3)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, rank, kind, least, own, told, gaps, unnest(range(1, len(own) + 1)) AS i FROM m),
s AS (SELECT doc_id, rank, kind, list_sum(gaps[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS pos, own[i] AS n FROM e WHERE told[i] >= least),
t AS (SELECT doc_id, rank, kind, CAST(pos AS BIGINT) AS pos, kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(pos + n AS BIGINT) AS said FROM s),
g AS (SELECT doc_id, string_agg(said, ',' ORDER BY pos, rank) AS spans, coalesce(string_agg(said, ',' ORDER BY pos, rank) {base}, '') AS base,
        count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c, count(*) FILTER (WHERE kind = 'hex') AS h FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


QUERIES = {"op2_secrets": op2_secrets}
ORACLES = {"op2_secrets": _oracle()}

"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Each pattern is matched in linear time whatever the text: repeats are possessive, starts are anchored by what
precedes them, and e-mail addresses are found from their @. Cards must pass Luhn's check, IBANs mod 97,
and those are cut at their country's length. A span's score is its kind's prior, raised if one of the kind's context words stands whole within NEAR characters.
Base kinds (email, ip, card, phone) are kept at any score; iban and ssn need THRESHOLD.

The work is row by row in Arrow slices: no shuffle, and memory bounded by a slice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import slices, small_batches, table

# The kinds in the order of the contract, then those that this method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "mails", "email", "emails", "contact", "write"),
    "ip": ("ip", "ips", "address", "addresses", "host", "hosts", "server", "servers"),
    "card": ("card", "cards", "visa", "mastercard", "credit", "debit", "payment", "payments"),
    "phone": ("phone", "phones", "telephone", "tel", "call", "calls", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
NEAR, RAISE, THRESHOLD = 40, 0.35, 0.5

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
STRETCH = re.compile(r"[0-9][0-9. -]{6,}+")  # where addresses, cards and such numbers can be
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", re.A)
IBAN_START = re.compile(r"\b[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])", re.A)
IBAN_END = re.compile(r"[A-Z0-9]\b", re.A)
# Lengths of IBANs by country, from the registry of ISO 13616.
IBAN_LENGTHS = {
    k: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB LC NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "RU",
    }.items()
    for k in names.split()
}
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.A)
NOT_DIGIT = re.compile(r"[^0-9]+")
NEARBY = {k: re.compile(r"[^A-Za-z](?:" + "|".join(words) + r")[^A-Za-z]", re.I | re.A) for k, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod_97(iban: str) -> bool:
    """Whether the check digits of an IBAN without spaces hold."""
    return int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the last match ended
    for m in DOMAIN.finditer(text):
        at = m.start()
        begin = max(free, text.rfind("@", free, at) + 1)
        start = begin + len(text[begin:at].rstrip(LOCAL_PART))
        if start < at:
            free = m.end()
            yield start, free


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs, whatever stands behind them: a match may run on into the words that follow, and is cut at its country's length.

    Where that fails the whole match is tried, and where the country is not known every end of a word. A start
    that gives none hides no later one. Each start looks at a bounded stretch.
    """
    free = 0
    for s in IBAN_START.finditer(text):
        if s.start() < free or not (m := IBAN.match(text, s.start())):
            continue
        ends = [e.end() for e in IBAN_END.finditer(text, m.start(), m.end() + 1) if e.end() <= m.end()][::-1]
        if known := IBAN_LENGTHS.get(m[0][:2]):
            ends = [e for e in ends if len(text[m.start() : e].replace(" ", "")) == known] + [m.end()]
        for end in ends:
            if 15 <= len(x := text[m.start() : end].replace(" ", "")) <= 34 and mod_97(x):
                free = end
                yield m.start(), end
                break


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed spans of every kind: start, end, kind; of one kind in order."""
    if "@" in text:
        for start, end in emails(text):
            yield start, end, "email"
    for stretch in STRETCH.finditer(text):
        begin, stop = stretch.span()
        for m in IP.finditer(text, begin, stop):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                yield m.start(), m.end(), "ip"
        for m in CARD.finditer(text, begin, stop):
            if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                yield m.start(), m.end(), "card"
        for m in SSN.finditer(text, begin, stop):
            yield m.start(), m.end(), "ssn"
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.start(), m.end(), "phone"
    for start, end in ibans(text):
        yield start, end, "iban"


def find(text: str | None) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) by start, then kind in the order of KINDS."""
    found, edged = [], None
    for start, end, kind in proposals(text or ""):
        if edged is None:
            edged = f" {text} "  # a position of text is one more here; each stretch has a character beyond its ends, so that words are whole
        near = NEARBY[kind].search(edged[max(0, start - NEAR) : start + 2]) or NEARBY[kind].search(edged[end : end + NEAR + 2])
        score = min(1.0, PRIOR[kind] + RAISE * bool(near))
        if kind in KINDS[:BASE] or score >= THRESHOLD:
            found.append((start, end, kind, score))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def digest(spans: list[tuple[int, int, str, float]]) -> dict:
    said = [f"{kind}:{start}:{end}" for start, end, kind, _ in spans]
    base = ",".join(x for x, s in zip(said, spans, strict=True) if s[2] in KINDS[:BASE])
    counts = {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS}
    return counts | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(said), "top_score": max((s[3] for s in spans), default=0.0)}


SPANS = "array<struct<start: bigint, end: bigint, kind: string, score: double>>"


def scan(docs: DataFrame) -> DataFrame:
    """The spans of personal data of every row of docs (doc_id, text): doc_id, found.

    Null and empty texts: no spans. Repeated rows and null ids: a row each. No rows: no rows. Other columns are
    ignored. Positions are code points, ends exclusive.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def found(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in find(t)] for t in texts], kind)]

    return by_text(docs, found, {"found": SPANS})


def digests(docs: DataFrame) -> DataFrame:
    """Counts by kind, digest and text of the spans, and the top score, of every row of docs, in the pass that finds them. See scan()."""

    def told(texts: list[str | None]) -> list[pa.Array]:
        rows = [digest(find(t)) for t in texts]
        return [pa.array([r[c] for r in rows], kind) for c, kind in OUT.items()]

    return by_text(docs, told, {c: SQL[kind] for c, kind in OUT.items()})


def by_text(docs: DataFrame, made: Callable[[list[str | None]], list[pa.Array]], columns: dict[str, str]) -> DataFrame:
    """doc_id, and the columns that are made of slices of texts."""

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *made(b.column(1).to_pylist())], ["doc_id", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [f"n_{k}" for k in KINDS[:BASE]] + ["base_sha256", "spans"] + [f"n_{k}" for k in KINDS[BASE:]] + ["top_score"]
    return digests(table(spark, sf_dir, "documents")).select("doc_id", *order)


OUT = {f"n_{k}": pa.int64() for k in KINDS} | {"base_sha256": pa.string(), "spans": pa.string(), "top_score": pa.float64()}
SQL = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}


def _oracle() -> str:
    """The spans in SQL: positions from what lies between matches, checksums and context by list functions."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": IBAN.pattern, "ssn": SSN.pattern,
    }
    each = " UNION ALL ".join(
        f"SELECT doc_id, text, {i} AS rank, '{k}' AS kind, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps, regexp_extract_all(text, '{p}') AS own FROM d WHERE regexp_matches(text, '{p}')"
        for i, (k, p) in enumerate(patterns.items())
    )
    luhn_ = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(digits, length(digits) - i + 1, 1) AS INTEGER) ELSE (2 * CAST(substr(digits, length(digits) - i + 1, 1) AS INTEGER)) // 10 + (2 * CAST(substr(digits, length(digits) - i + 1, 1) AS INTEGER)) % 10 END)) % 10 = 0"
    turned = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    mod = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {value})), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    prior = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in PRIOR.items())
    context = " ".join(f"WHEN '{k}' THEN '(?i)[^A-Za-z]({'|'.join(w)})[^A-Za-z]'" for k, w in CONTEXT.items())
    near = f"regexp_matches(substr(' ' || text || ' ', greatest(pos - {NEAR}, 0) + 1, pos + 2 - greatest(pos - {NEAR}, 0)), CASE kind {context} END) OR regexp_matches(substr(' ' || text || ' ', pos + n + 1, {NEAR} + 2), CASE kind {context} END)"
    count = lambda k: f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}"
    zeros = lambda k: f"coalesce(n_{k}, 0) AS n_{k}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({each}),
e AS (SELECT doc_id, text, rank, kind, gaps, own, unnest(range(1, len(own) + 1)) AS i FROM p),
s AS (SELECT doc_id, text, rank, kind, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(own[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, length(own[i]) AS n, own[i] AS m, regexp_replace(own[i], '[^0-9]', '', 'g') AS digits FROM e),
v AS (SELECT *, CASE kind {prior} END + CASE WHEN {near} THEN CAST({RAISE} AS DOUBLE) ELSE 0 END AS score FROM s WHERE CASE kind
  WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INTEGER) END)) <= 255
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND {luhn_} WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {mod} ELSE TRUE END),
t AS (SELECT *, kind || ':' || pos || ':' || (pos + n) AS said FROM v WHERE rank < {BASE} OR least(score, 1) >= {THRESHOLD}),
g AS (SELECT doc_id, {', '.join(map(count, KINDS))}, string_agg(said, ',' ORDER BY pos, rank) AS spans, coalesce(string_agg(said, ',' ORDER BY pos, rank) FILTER (WHERE rank < {BASE}), '') AS base, least(max(score), 1) AS top_score FROM t GROUP BY doc_id)
SELECT d.doc_id, {', '.join(map(zeros, KINDS))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top_score, 0.0) AS top_score FROM d LEFT JOIN g USING (doc_id)
"""


QUERIES = {"op1_pii": op1_pii}
ORACLES = {"op1_pii": _oracle()}

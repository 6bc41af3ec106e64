"""Language identification of mixed-language texts.

Learning: grams of one to three letters and whole words, counted by language over a sample of labelled rows
of at most TRAIN_DOCS documents: the first in a seeded order that goes round the languages, so that a rare one is
sampled whole before a common one takes more than its turn; of more languages than that, each has one. The counts are added up
by Spark, and all of them reach the driver: what TRAIN_DOCS documents hold. No language and no gram is dropped.

Prediction: the script of a word's first letter leaves as candidates the languages learnt with that script. Grams
that no language has weigh the same for all. A word of a script that no language was learnt with speaks for none of
them: FLOOR for each, not their share, which would be sure enough with one or two languages. Each other word has the log of each candidate's posterior, FLOOR at least. Viterbi with a price SWITCH for a change of
language labels the words, so spans come out. Most texts have one language; for those a bound tells that
no switch can pay: within any stretch no other language gains more than SWITCH on the best one of the text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LONG_WORD, slices, small_batches, table

TRAIN_DOCS = 6000
SEED = 5
FLOOR, SWITCH = -4.0, 8.0
PRIOR = 2000.0
#: A document of which less than this share of letters is surely in its language is rejected in the pipeline.
ACCEPT = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
#: Most words with known scores in a Python worker; those of more than LONG_WORD characters are known for a slice only.
WORDS = 400_000
# First code points of ranges of scripts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
STARTS, NAMES = np.array([x[0] for x in SCRIPTS]), [x[1] for x in SCRIPTS]


def script(word: str) -> str:
    return NAMES[int(np.searchsorted(STARTS, ord(word[0]), "right")) - 1] if word[0] > "ɏ" else "latin"


def grams(word: str) -> list[str]:
    """Grams of a lower-cased word between marks of its ends, and the word itself."""
    w = f"^{word}$"
    return [*w[1:-1], *map("".join, zip(w, w[1:], strict=False)), *map("".join, zip(w, w[1:], w[2:], strict=False)), f"={word}"]


class Model(NamedTuple):
    """codes: sorted codes of grams of letters, whose rows in weights are the first; words: sorted marks of whole words, whose rows follow; the last rows are for grams not seen."""

    langs: list[str]
    codes: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    scripts: dict[str, np.ndarray]

    def unseen(self, kind: int) -> int:
        """The row for a gram that was not seen: of one, two or three letters, or a word (4)."""
        return len(self.weights) - 5 + kind


    def rows(self, letters: bool, keys: np.ndarray, kind: int) -> np.ndarray:
        """The rows of codes, or of marks of words; of those not seen, that of their kind."""
        table, first = (self.codes, 0) if letters else (self.words, len(self.codes))
        if not len(table):
            return np.full(len(keys), self.unseen(kind))
        place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[place] == keys, first + place, self.unseen(kind))


def mark(word: str) -> int:
    """A word as 64 bits: a table of words is read by many workers, each of which would hold its strings."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def code(gram: str) -> int:
    """Up to three characters as an integer."""
    return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))


def held_out(doc_id: Column) -> Column:
    """Whether a row is not to be learnt from: crc32 of the id as text, modulo 3, is 1. A null id is as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def in_turn(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many of `most` each takes if they are dealt in turn to those that have some left; one each at least."""
    out, left, open_ = {}, most, sorted(sizes, key=lambda k: (sizes[k], k))
    for i, k in enumerate(open_):
        out[k] = max(1, min(sizes[k], left // (len(open_) - i)))
        left -= out[k]
    return out


def hash_bound(share: int, size: int) -> int:
    """A 64-bit hash that more than `share` of `size` hashes stay below but for a chance of 1e-30 or so; all, if they are few."""
    part = (share + 12 * share**0.5 + 100) / size
    return (1 << 63) - 1 if part >= 1 else int(-(1 << 63) + part * (1 << 64))


def tabled(counts: pa.Table, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of counts (lang, gram, n), a row for each gram, letters first and by key: its key, its kind (letters; 4: a word), its counts by language; and the scripts.

    In arrays: objects of as many grams were most of what the driver's Python held.
    """
    grams = counts["gram"].combine_chunks().dictionary_encode()
    row, lang, n = grams.indices.to_numpy(), pc.index_in(counts["lang"], value_set=pa.array(langs, pa.string())).to_numpy(), counts["n"].to_numpy()
    keys, kind = np.zeros(len(grams.dictionary), np.uint64), np.zeros(len(grams.dictionary), np.int64)
    scripts: dict[str, np.ndarray] = {}
    for start in range(0, len(keys), 8192):
        for i, gram in enumerate(grams.dictionary.slice(start, 8192).to_pylist(), start):
            if gram[0] == "#" and len(gram) > 1:
                scripts[gram[1:]] = np.isin(np.arange(len(langs)), lang[row == i])
            elif gram[0] == "=":
                keys[i], kind[i] = mark(gram[1:]), 4
            else:
                keys[i], kind[i] = code(gram), len(gram)
    order = np.lexsort((keys, kind == 4))
    order = order[kind[order] > 0]
    place = np.full(len(keys), len(order))  # of scripts: a row behind all others
    place[order] = np.arange(len(order))
    out = np.zeros((len(order) + 1, len(langs)), np.float32)
    out[place[row], lang] = n
    return keys[order], kind[order], out[:-1], scripts


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from rows of docs (doc_id, text, lang) that are labelled and not held out.

    Bound: train_docs rows, dealt to the languages in turn, one each at least, by a seeded order within each (repeated rows
    count once). A language with few rows has all of them, and every language, script and gram of the sample is
    learnt. Without such rows the model knows no language.

    A gram's probability in a language leans towards its mean over the languages, as PRIOR grams would; so a language of
    which little is known is not likelier than others for what is rare in them.
    """
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", "text", F.lit(SEED))
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", order.alias("o"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((5, 0), np.float32), {})
    shares = in_turn(sizes, train_docs)
    # A hash is uniform, so a bound on it keeps little more than the share; the rest is cut exactly, in tasks of a bounded number of rows.
    spark = docs.sparkSession
    told = F.broadcast(spark.createDataFrame([(k, shares[k], hash_bound(shares[k], n)) for k, n in sizes.items()], "lang string, share long, near long"))  # a row a language
    near = rows.join(told, "lang").filter(F.col("o") <= F.col("near")).select("lang", "o", "share").distinct()
    last = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).filter(F.col("nth") <= F.col("share"))
    ends = F.broadcast(spark.createDataFrame(last.groupBy("lang").agg(F.max("o").alias("end")).collect(), "lang string, end long"))  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(n: Counter) -> pa.RecordBatch:
            lang, gram = zip(*n, strict=True) if n else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "gram", "n"])

        seen: Counter = Counter()
        for b in slices(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
            for lang, own in words.items():
                for w, n in own.items():
                    for g in (*grams(w), f"#{script(w)}"):
                        seen[lang, g] += n
            if len(seen) > 300_000:
                yield rows_of(seen)
                seen.clear()
        yield rows_of(seen)

    part = rows.join(ends, "lang").filter(F.col("o") <= F.col("end")).dropDuplicates(["lang", "o"]).select("lang", "text")
    counts = part.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    keys, kind, n, scripts = tabled(counts.toArrow(), langs)  # what train_docs documents hold
    weights = np.zeros((len(n) + 5, len(langs)))
    for k in range(1, 5):  # letters, pairs, triples and words have distributions of their own
        own = n[kind == k]
        total = own.sum(0)
        mean = (own / np.maximum(total, 1)).sum(1, keepdims=True) / max(1, (total > 0).sum())
        weights[:-5][kind == k] = np.log((own + PRIOR * mean) / (total + PRIOR))
        weights[len(n) + k] = 0.0  # no evidence for any language
    return Model(langs, keys[kind < 4], keys[kind == 4], weights.astype(np.float32), scripts)


class Scorer:
    """Log posteriors of words, kept for those seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.may = np.array([model.scripts.get(x, np.zeros(len(model.langs), bool)) for x in NAMES])
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.passing: list[str] = []
        self.scores = np.zeros((WORDS + 1, max(1, len(self.model.langs))), np.float32)
        self.letters = np.zeros(WORDS + 1, np.int32)

    def stem(self, words: list[str]) -> np.ndarray:
        """Scores of words of letters, all at once."""
        m = self.model
        sizes = np.array([len(w) + 2 for w in words])
        points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum([0, *sizes])[:-1]
        left = np.repeat(starts + sizes, sizes) - np.arange(len(points))  # to the end of the word
        inside = left > 1
        inside[starts] = False
        second, third = np.append(points[1:], 0).astype(np.uint64), np.append(points[2:], (0, 0)).astype(np.uint64)
        bits = np.uint64(21)
        sums = np.zeros((len(points), len(m.langs)))
        for kind, codes, may in ((1, points, inside), (2, points << bits | second, left > 1), (3, (points << bits | second) << bits | third, left > 2)):
            sums[may] += m.weights[m.rows(True, codes[may], kind)]
        whole = m.weights[m.rows(False, np.array([mark(w) for w in words], np.uint64), 4)]
        out = np.add.reduceat(sums, starts, axis=0) + whole
        may = self.may[np.searchsorted(STARTS, points[starts + 1].astype(np.int64), "right") - 1]
        learnt = may.any(1)
        out[learnt[:, None] & ~may] = -np.inf
        out -= out.max(1, keepdims=True)
        out = np.maximum(out - np.log(np.exp(out).sum(1, keepdims=True)), FLOOR)
        out[~learnt] = FLOOR
        return out

    def learn(self, chunks: set[str]) -> None:
        new = sorted((c for c in chunks if c not in self.words), key=lambda c: len(c) > LONG_WORD)
        self.passing = [c for c in new if len(c) > LONG_WORD]  # the last rows; see drop
        parts = [LETTERS.findall(c.lower()) for c in new]
        stems = list({w for p in parts for w in p})
        row = {w: i for i, w in enumerate(stems)}
        scored = self.stem(stems) if stems else np.zeros((0, 1))
        first = len(self.words)
        self.words.update(zip(new, range(first, first + len(new)), strict=True))
        if not stems:
            return
        # Most chunks have one word of letters; several are added up, none adds nothing.
        owner = np.repeat(np.arange(first, first + len(new)), [len(p) for p in parts])
        flat = [w for p in parts for w in p]
        np.add.at(self.scores, owner, scored[[row[w] for w in flat]])
        np.add.at(self.letters, owner, [len(w) for w in flat])

    def drop(self) -> None:
        """Forgets the long words of the last slice, whose rows are the last ones."""
        for c in self.passing:
            at = self.words.pop(c)
            self.scores[at] = self.letters[at] = 0
        self.passing = []

    def chunks(self, words: list[list[str]]) -> list[np.ndarray]:
        """Rows of the tables for the words of each text. Clears the tables before they are full."""
        self.drop()
        if len(self.words) + len(every := set().union(*words)) > WORDS:
            self.forget()
            if len(every) > WORDS:  # one slice with very many words: tables of its size, for this time
                self.scores, self.letters = np.zeros((len(every) + 1, self.scores.shape[1]), np.float32), np.zeros(len(every) + 1, np.int32)
        self.learn(every)
        return [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in words]


def viterbi(scores: np.ndarray, price: float = SWITCH) -> np.ndarray:
    """The best label of each row, a change costing price; the first of equals."""
    k = scores.shape[1]
    best = scores[0].tolist()
    ahead = array("d", best)  # what the labels have before each row but the first, and at the end
    for row in scores[1:].tolist():  # plain floats: there are few labels and many rows
        floor = max(best) - price
        best = [(b if b >= floor else floor) + s for b, s in zip(best, row, strict=True)]
        ahead.extend(best)
    had = np.frombuffer(ahead).reshape(-1, k)
    top = had.argmax(1)
    switched = had < (had.max(1) - price)[:, None]
    changes = np.flatnonzero(switched[:-1].any(1))[::-1].tolist()
    out = np.empty(len(scores), np.int64)
    now, upto = int(top[-1]), len(scores)
    for i in changes:  # between them a label stays what it was
        if switched[i, now]:
            out[i + 1 : upto] = now
            now, upto = int(top[i]), i + 1
    out[:upto] = now
    return out


def one_language(scores: np.ndarray, starts: np.ndarray, price: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose rows lie one after the other: the best label of each, and whether no switch can pay there."""
    sizes = np.diff([*starts, len(scores)])
    total = np.add.reduceat(scores.astype(np.float64), starts, axis=0)
    best = total.argmax(1)
    gain = scores.astype(np.float64) - np.take_along_axis(scores.astype(np.float64), np.repeat(best, sizes)[:, None], 1)
    most = np.zeros(len(starts))
    apart = np.repeat(np.arange(len(starts)), sizes) * (10.0 * (1 + np.abs(gain).max()) * (1 + sizes.max()))
    for k in range(scores.shape[1]):
        up = np.cumsum(gain[:, k])
        ahead = up - gain[:, k]
        low = np.minimum.accumulate(ahead - apart) + apart  # the lowest so far in the same text
        most = np.maximum(most, np.maximum.reduceat(up - low, starts))
    return best, most <= price - 1e-3


def label(scorer: Scorer, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, str]]]]:
    """For each text its language, score, and spans: (words, language) one after the other; words are split at white space."""
    langs = scorer.model.langs
    words = [t.split() if t else [] for t in texts]
    out: list[tuple[str, float, list[tuple[int, str]]]] = [("und", 0.0, [])] * len(texts)
    if not langs:
        return out
    ids = scorer.chunks(words)
    letters = [scorer.letters[i] for i in ids]
    live = [i for i in range(len(texts)) if letters[i].any()]
    if not live:
        return out
    scores = scorer.scores[np.concatenate([ids[i] for i in live])]
    starts = np.cumsum([0, *(len(ids[i]) for i in live)])[:-1]
    best, alone = one_language(scores, starts)
    for nth, i in enumerate(live):
        own = scores[starts[nth] : starts[nth] + len(ids[i])]
        path = np.full(len(own), best[nth]) if alone[nth] else viterbi(own)
        weight = np.bincount(path, letters[i], len(langs))
        top = int(weight.argmax())
        sure = np.exp(np.minimum(own[:, top], 0.0)) * (path == top)
        cuts = np.flatnonzero(np.diff(path)) + 1
        spans = [(int(b - a), langs[path[a]]) for a, b in zip([0, *cuts], [*cuts, len(path)], strict=True)]
        out[i] = (langs[top], float((sure * letters[i]).sum() / letters[i].sum()), spans)
    return out


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every row of docs (doc_id, text): doc_id, lang_pred, score, spans, and the columns named in keep.

    score: mean probability of lang_pred over the letters, 0 where another language was labelled and exp(FLOOR) in a
    script that no language was learnt with. spans: stretches of
    words with one label, as words:language, comma-joined. Null text, or none with letters: und, 0 and no
    spans; and so without a language learnt. Repeated rows and null ids: a row each. No rows: none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what TRAIN_DOCS documents hold
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.string())])

    @F.arrow_udf("lang_pred string, score double, spans string")
    def said(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for whole in texts:
            parts = []
            for b in slices([pa.RecordBatch.from_arrays([whole], ["text"])]):
                found = label(scorer, b.column(0).to_pylist())
                columns = [[x[0] for x in found], [x[1] for x in found], [",".join(f"{n}:{k}" for n, k in x[2]) for x in found]]
                parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    # Only texts go to Python; the rest of a row stays where it is. Called nondeterministic, it is evaluated once, filters or not.
    keep = tuple(c for c in keep if c != "doc_id")
    return docs.select("doc_id", *keep, said.asNondeterministic()("text").alias("said")).select("doc_id", "said.*", *keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}

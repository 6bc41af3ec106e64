"""Cost-balanced packing of documents into sequences.

A document's cost is its tokens plus QUADRATIC times their square, as attention has it. A task fills windows
of WINDOW sequences: whole stretches of a sequence's length are sequences of their own; what is left of
each document goes, longest first, to the sequence of lowest cost with room for it. A remainder for which none
has room is cut into the cheapest sequences that have any. A window takes just as many tokens as it
holds, the last document being cut at its end; so only the last window of a task has fewer. Its end is
cut at powers of two, which need no padding.

No shuffle: each task packs its own partition, in memory bounded by a window. Sequence ids hold the
partition's number in their high bits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import LONG_WORD, slices, small_batches, table
from .tokencount import tokenizer_path

MODEL = "word_bpe_49k.json"
END = 2
LENGTH = 4096
WINDOW = 256
QUADRATIC = 1 / 4096
#: Most words with known ids in a Python worker, in each of two generations; none of more than LONG_WORD characters.
WORDS = 300_000
PUNCTUATION = ".,;:!?|"
#: Words of letters that are encoded in one call.
JOINED = 1000


def is_letters(word: str) -> bool:
    """Whether a word and its lower case are letters only, one stretch to the tokenizer."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


#: The tokenizer's own pieces, in lower-case text of U+0000 to U+00FF.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class Words(dict[str, bytes]):
    """Ids of words of lower-case Latin-1 text, by the tokenizer's model, a piece at a time as they are asked for; none that is long is kept."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenize = tokenizer.model.tokenize
        self.ids = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.as_bytes = {x: as_bytes.pre_tokenize_str(chr(x))[0][0] for x in range(0x100)}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.get(word)) is None:
            pieces = () if word.isalpha() else PIECES.findall(word)
            if len(pieces) > 1:
                out = b"".join(map(self.__getitem__, pieces))
            else:
                plain = word if word.isascii() and word.isprintable() else word.translate(self.as_bytes)
                out = b"".join([self.ids[t.id] for t in self.tokenize(plain)])
        if len(word) <= LONG_WORD:
            self[word] = out
        return out

    def turn(self) -> None:
        """Begins a new generation when this one is full."""
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()


def is_latin(text: str) -> bool:
    """Whether a text is of U+0000 to U+00FF only, and lower case leaves the tokenizer's special strings as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


class Encoder:
    """Ids of whole texts, by word: this tokenizer drops white space and looks at nothing across it.

    Latin-1 texts are lower-cased, as the tokenizer does, and their words cut as it does; only its model is asked. In others a
    word that is letters of any alphabet and one mark behind them is the ids of both: the tokenizer splits
    there. Texts with the separators that Python and the tokenizer see differently go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.words = Words(self.tokenizer)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: of many at a time, cut behind each token that ends a word."""
        ids = np.asarray(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # the tokenizer knows another Unicode version's letters
            return self.whole(words)
        every, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [every[a:b] for a, b in zip(at, at[1:], strict=False)]

    def ids_of(self, plain: list[str], rest: list[str]) -> dict[str, bytes]:
        """Ids of words of letters and of others."""
        out = dict(zip(rest, self.whole(rest), strict=True))
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            out.update(zip(some, self.letters(some), strict=True))
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        known, old, out = self.words, self.words.older, {}
        plain, rest, split = set(), set(), []
        for w in words:
            if (ids := known.get(w)) is None:
                if (ids := old.get(w)) is None:
                    stem = w[:-1]
                    if w[-1] not in PUNCTUATION:
                        (plain if is_letters(w) else rest).add(w)
                    elif is_letters(stem):
                        split.append(w)
                        if stem not in words:
                            if (own := known.get(stem) or old.get(stem)) is not None:
                                out[stem] = own
                            else:
                                plain.add(stem)
                        if w[-1] not in words:
                            rest.add(w[-1])
                    else:
                        rest.add(w)
                    continue
                known[w] = ids
            out[w] = ids
        out.update(fresh := self.ids_of(list(plain), list(rest)))
        for w in split:
            out[w] = fresh[w] = out[w[:-1]] + out[w[-1]]
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONG_WORD)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids."""
        self.words.turn()
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        latin = [not o and is_latin(t) for t, o in zip(texts, odd, strict=True)]
        words = [[] if o or a else t.split() for t, o, a in zip(texts, odd, latin, strict=True)]
        ids = self.learn(set().union(*words)) if any(words) else {}
        whole = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
        own = self.words.__getitem__
        return [b"".join(map(own, t.lower().split())) if a else next(whole) if o else b"".join(map(ids.__getitem__, w)) for t, w, o, a in zip(texts, words, odd, latin, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def place(sizes: list[int], rooms: list[int], quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Places pieces into sequences: (piece, start in it, length, sequence), in the order in which they were placed.

    rooms: the token capacity of each sequence; they hold all pieces together, or ValueError.
    """
    if sum(sizes) > sum(rooms):
        raise ValueError("the pieces need more room than there is")
    room, cost, out = np.array(rooms, np.int64), np.zeros(len(rooms)), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start, left = 0, sizes[i]
        while left:
            fit = room >= left
            if not fit.any():
                fit = room > 0
            at = int(np.argmin(np.where(fit, cost, np.inf)))
            n = min(left, int(room[at]))
            out.append((i, start, n, at))
            room[at] -= n
            cost[at] += n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack_stream(docs: Iterator[tuple[object, bytes]], length: int = LENGTH, window: int = WINDOW) -> Iterator[list[tuple]]:
    """Lists of pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence, offset) of documents with their ids."""
    sequence, held, tokens = 0, [], 0

    def piece(doc: object, ids: bytes, start: int, n: int, at: int, offset: int) -> tuple:
        return doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, at, offset

    def fill(rooms: list[int]) -> list[tuple]:
        nonlocal sequence
        used, out = [0] * len(rooms), []
        for i, start, n, at in place([n for _, _, _, n in held], rooms):
            doc, ids, first, _ = held[i]
            out.append(piece(doc, ids, first + start, n, sequence + at, used[at]))
            used[at] += n
        sequence += len(rooms)
        return out

    for doc, ids in docs:
        total, start, out = len(ids) // 4, 0, []
        while total - start >= length:
            out.append(piece(doc, ids, start, length, sequence, 0))
            sequence, start = sequence + 1, start + length
        n = min(total - start, window * length - tokens)
        if n:
            held.append((doc, ids, start, n))
            tokens += n
        if tokens == window * length:
            out += fill([length] * window)
            held, tokens = [], 0
            if start + n < total:
                held, tokens = [(doc, ids, start + n, total - start - n)], total - start - n
        if out:
            yield out
    if tokens:
        yield fill([length] * (tokens // length) + powers(tokens % length))


PIECE = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def pack(docs: DataFrame, model: str | None = None, end: int = END, length: int = LENGTH) -> DataFrame:
    """The pieces of every row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts: one piece with the end token only. Repeated rows and null ids: packed each by
    itself. No rows: none. Other columns are ignored. Equal lengths are placed in the order in which they
    came. model: path of the tokenizer's file, which each executor must have.
    """
    small_batches(docs.sparkSession)
    path = model or tokenizer_path(MODEL)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, last, named = TaskContext.get().partitionId() << 40, np.array([end], "<u4").tobytes(), None

        def read() -> Iterator[tuple[object, bytes]]:
            nonlocal named
            for b in slices(batches):
                named = b.schema.field(0).type
                ids = encoder(path).encode([t or "" for t in b.column(1).to_pylist()])
                yield from ((d, i + last) for d, i in zip(b.column(0).to_pylist(), ids, strict=True))

        for pieces in pack_stream(read(), length):
            doc, *rest = zip(*pieces, strict=True)
            rest[4] = [high | x for x in rest[4]]
            yield pa.RecordBatch.from_arrays([pa.array(doc, named), *(pa.array(x, k) for x, k in zip(rest, PIECE.values(), strict=True))], ["doc_id", *PIECE])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in PIECE))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}

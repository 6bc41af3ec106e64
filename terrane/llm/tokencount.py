"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A BPE encoding is valid exactly if each two neighbouring tokens are what BPE makes of the two together, and
each prefix of a text has one valid encoding. So a machine that reads characters need only know, for the
positions where a longer token could still begin, which token ended there and how many there were. That is
a state; the transition to the next carries the change of the count. Transitions are compiled when a
text first needs them and kept in a bounded table.

A space that follows another character, and a line break, bring the machine back to its start, for no token crosses
that boundary. Texts are cut there into chunks, and chunks longer than PIECE into pieces. A chunk has a state map: from
the state in which the machine enters to the one in which it leaves, with the tokens counted between. Maps compose
associatively. That of a chunk behind a boundary is the same for all entering states, so a scan over the
chunks of many texts is a running sum of their counts; the pieces of a long chunk have maps that are filled in for
the states that occur, and are composed in a tree. Maps of chunks are kept in a bounded table.

Runs of spaces, whose tokens tie in score, are left to plain BPE; so are the pairs of tokens above.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import LONG_WORD, slices, small_batches, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a piece of a chunk; and about so many of a text are cut into chunks at a time.
PIECE, STRETCH = 1024, 1 << 20
#: Most entries of the tables of chunks (in each of two generations), transitions and pairs in a Python worker.
CHUNKS, ARCS, PAIRS = 200_000, 400_000, 400_000
#: How a transition is packed: so many bits for the change of the count, which is in -HALF..HALF.
BITS, HALF, MASK = 6, 32, 63
#: Chunks of a text that begins with a space: behind a line break, behind a run of spaces, behind one space.
CUT = re.compile(r"\n[^ \n]*|  +[^ \n]*| [^ \n]*")
BOUNDARY = re.compile("[^ ](?= )")


class StateMap:
    """What a stretch of text does to the machine: leaving state and count for each entering state, found when first asked for."""

    def __init__(self, run: Callable[[int], tuple[int, int]]):
        self.run, self.known = run, {}

    def __getitem__(self, state: int) -> tuple[int, int]:
        if (to := self.known.get(state)) is None:
            to = self.known[state] = self.run(state)
        return to

    def then(self, other: StateMap) -> StateMap:
        def run(state: int) -> tuple[int, int]:
            middle, n = self[state]
            end, m = other[middle]
            return end, n + m

        return StateMap(run)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: in TERRANE_TOKENIZERS, or as the installed package says."""
    if folder := os.environ.get("TERRANE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    """Counts of the tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        # The library's own BPE, without the space that it puts before a text, tells which tokens may be neighbours.
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = proto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.scores = {p: proto.pieces[i].score for p, i in self.ids.items()}
        self.starts = {p[:n] for p in self.ids for n in range(len(p))}
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: the longest end of what was read that begins a token; the token that ended at each of its positions; the counts there, from the last.
        first = ("", (None,), (0,))
        self.states, self.names = [first], {first: 0}
        #: By state and character: the next state and the change of the count, in one integer each.
        self.arcs: dict[int, int] = {}

    def bpe(self, text: str) -> list[str]:
        """Plain BPE: the pair of the best score first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.scores.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], after[a] = both, None, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def follows(self, a: int | None, b: int) -> bool:
        """Whether BPE leaves b as it is, behind a if there is one."""
        key = b if a is None else (a + 1) << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            one = self.pieces[b]
            known = self.pairs[key] = self.plain.encode(one if a is None else self.pieces[a] + one) == ([b] if a is None else [a, b])
        return known

    def arc(self, state: int, c: str) -> int:
        """Compiles the transition of a state by a character."""
        end, lasts, counts = self.states[state]
        if c not in self.ids:  # its bytes are tokens, and nothing joins across it
            return len(c.encode("utf-8", "surrogatepass")) + HALF
        whole = end + c
        for n in range(len(whole)):
            piece = self.ids.get(whole[n:]) if counts[n] is not None else None
            if piece is not None and self.follows(None, piece) and (lasts[n] is None or self.follows(lasts[n], piece)):
                last, emitted = piece, counts[n] + 1
                break
        live = [n for n in range(len(whole) + 1) if whole[n:] in self.starts]  # where a longer token may begin, the end among them
        lasts, counts = (*lasts, last), (*counts, emitted)
        size = range(live[0], len(whole) + 1)
        name = (whole[live[0] :], tuple(lasts[n] if n in live else None for n in size), tuple(counts[n] - emitted if n in live else None for n in size))
        if name not in self.names:
            self.names[name] = len(self.states)
            self.states.append(name)
        return self.names[name] << BITS | emitted + HALF

    def walk(self, state: int, text: str) -> tuple[int, int]:
        """The state behind a text without runs of spaces, and the tokens counted."""
        total, arcs = 0, self.arcs
        for c in map(ord, text):
            if (to := arcs.get(state << 21 | c)) is None:
                to = arcs[state << 21 | c] = self.arc(state, chr(c))
            state = to >> BITS
            total += (to & MASK) - HALF
        return state, total

    def run(self, chunk: str) -> int:
        """Tokens of a chunk, from the start state. The table of transitions is emptied before a chunk, never in it."""
        if len(self.arcs) >= ARCS:
            self.reset()
        if len(chunk) <= PIECE:
            return self.walk(0, chunk)[1]
        cut = [chunk[i : i + PIECE] for i in range(0, len(chunk), PIECE)]
        own = {p: StateMap(partial(self.walk, text=p)) for p in cut}
        maps = [own[p] for p in cut]
        while len(maps) > 1:
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][0][1]

    def first(self, chunk: str) -> int:
        """Tokens of a chunk as chunks_of() gives it."""
        if chunk[:1] == "\n":
            return 1 + self.run(chunk[1:])
        if chunk[:2] == "  ":
            return self.plainly(chunk.replace(" ", SPACE))
        return self.run(SPACE + chunk)

    def learn(self, chunks: set[str]) -> dict[str, int]:
        """Counts of chunks; those of long ones are not kept."""
        known, old, out = self.chunks, self.older, {}
        if len(known) >= CHUNKS:
            self.older = old = known
            self.chunks = known = {}
        for c in chunks:
            if (n := known.get(c)) is None:
                if (n := old.get(c)) is None:
                    n = self.first(c)
                if len(c) <= LONG_WORD:
                    known[c] = n
            out[c] = n
        return out

    def plainly(self, text: str) -> int:
        """Plain BPE; unknown characters count as their bytes."""
        return sum(1 if p in self.scores else len(p.encode("utf-8", "surrogatepass")) for p in self.bpe(text))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: a scan over the counts of the chunks of all of them."""
        cuts = [(i, chunks_of(part)) for i, t in enumerate(texts) if t for part in stretches(f" {t.replace(SPACE, ' ')}")]
        counts = self.learn(set().union(*(c for _, c in cuts)))
        ahead = np.cumsum(np.fromiter(chain([0], map(counts.__getitem__, chain.from_iterable(c for _, c in cuts))), np.int64))
        ends = np.cumsum([0, *(len(c) for _, c in cuts)])
        return np.bincount([i for i, _ in cuts], ahead[ends[1:]] - ahead[ends[:-1]], len(texts)).astype(np.int64).tolist() if cuts else [0] * len(texts)


def chunks_of(text: str) -> list[str]:
    """Chunks of a text that begins with a space: each without the one space before it, behind a line break, or behind a run of spaces."""
    if "  " not in text:
        return text[1:].replace("\n", " \n").split(" ")
    return [c if c[0] == "\n" or c[:2] == "  " else c[1:] for c in CUT.findall(text)]


def stretches(text: str) -> Iterator[str]:
    """A long text in parts, each up to a boundary, so that not all its chunks are in memory at a time."""
    at = 0
    while len(text) - at > STRETCH and (m := BOUNDARY.search(text, at + STRETCH)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


@lru_cache(maxsize=1)
def transducer(model: str) -> Transducer:
    """One for each Python worker."""
    return Transducer(model)


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null text: as empty, no bytes and no tokens. Repeated rows and null ids: a row each. No rows: none. Other
    columns are ignored. model: path of the model's file, which each executor must have.
    """
    small_batches(docs.sparkSession)
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = machine.count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}

"""Odd rows by value: against plain Python, the tokenizers' libraries and what the results promise."""

import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from terrane.llm import mixing, packing, sharding, tokencount
from test_edges import ROWS, SCHEMA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def known(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_token_counts(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=tokencount.tokenizer_path(tokencount.MODEL))
    want = [(d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t, *_ in ROWS]
    assert known(map(tuple, tokencount.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == known(want)


def test_pieces(docs):
    library = Tokenizer.from_file(tokencount.tokenizer_path(packing.MODEL))
    got, whole = packing.pack(docs).collect(), {}
    for d, t, *_ in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        whole.setdefault(d, []).append(ids)
    for d, texts in whole.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == d)
        assert sum(n for _, n, *_ in pieces) == sum(map(len, texts))
        for start, n, crc, total in pieces:
            assert any(len(ids) == total and zlib.crc32(ids[start : start + n].tobytes()) == crc for ids in texts)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [at for at, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_placement_is_that_of_a_plain_search_and_costs_are_even():
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes = [int(x) for x in np.minimum(rng.lognormal(5, 1.2, 400), 1023)]
        count = -(-sum(sizes) // 1024) + 1
        got = packing.place(sizes, [1024] * count, 1 / 1024)
        room, cost, want = [1024] * count, [0.0] * count, []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            start, left = 0, sizes[i]
            while left:
                at = min((s for s in range(count) if room[s] >= left), key=lambda s: (cost[s], s), default=None)
                at = min((s for s in range(count) if room[s] > 0), key=lambda s: (cost[s], s)) if at is None else at
                n = min(left, room[at])
                want.append((i, start, n, at))
                room[at] -= n
                cost[at] += n + n * n / 1024
                start, left = start + n, left - n
        assert got == want
        # No two sequences but the last filled one differ by more than the costliest piece.
        even = sorted(c for c, r in zip(cost, room, strict=True) if r < 512)
        assert even[-1] - even[0] <= max(n + n * n / 1024 for n in sizes)


def test_shards(docs):
    got = sharding.shard(docs, 4).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS]
    assert known((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == known(want)
    for crc in {r["text_crc32"] for r in got}:
        assert len({r["shard"] for r in got if r["text_crc32"] == crc}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["shard"] for r in got} <= set(range(4)) and {r["law"] for r in got} == {"bytes"}


def water(sizes, weights, cap):
    """Targets by plain rounds of clamping, exactly."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    while open_:
        share = {i: Fraction(total - sum(out.values())) * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = {i for i in open_ if share[i] >= cap * sizes[i]}
        if not full:
            return out | share
        out |= {i: Fraction(cap * sizes[i]) for i in full}
        open_ -= full
    return out


def test_mix(docs):
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    names = sorted({r[3] for r in ROWS if r[3] is not None}) + [None]
    sizes = [sum(size(t) for _, t, _, s, _ in ROWS if s == name) for name in names]
    targets = water(sizes, [i % 3 + 1 for i in range(len(names))], 3)
    got = mixing.mix(docs).collect()
    assert known((r["doc_id"], r["size"], r["source_size"]) for r in got) == known((d, size(t), sizes[names.index(s)]) for d, t, _, s, _ in ROWS)
    for i, name in enumerate(names):
        own = [r for r in got if r["source"] == name]
        taken = [r["whole"] * r["size"] + r["extra"] for r in own]
        assert all(r["target"] == pytest.approx(float(targets[i])) for r in own) and abs(sum(taken) - float(targets[i])) <= 1
        assert all(n <= 3 * r["size"] for n, r in zip(taken, own, strict=True))


def test_latin_words_are_the_tokenizers_by_its_model_alone(monkeypatch):
    e = packing.Encoder(tokencount.tokenizer_path(packing.MODEL))
    rng = np.random.default_rng(5)
    marks = [chr(x) for x in range(0x100) if not 0x1C <= x <= 0x1F]
    texts = ["".join(rng.choice(marks, 200)) for _ in range(300)]
    texts += ["It's THEY'RE i'd''s o'clock x'LL 'S ''ve _a_1b²c¼ aªbºµ ÀÉÿß×÷ end.,;*** $$$ a\x85b\xa0c\x7f\xad", "word " * 50 + "y" * 300, "", " \n"]
    texts += ["<|startoftext|> A<|endoftext|>B", "a<|STARTOFTEXT|>b", "Ünder Ж İI ſt œuvre á é"]
    monkeypatch.setattr(packing, "WORDS", 500)
    want = e.whole(texts)
    for i in range(0, len(texts), 20):
        assert e.encode(texts[i : i + 20]) == want[i : i + 20]
    assert all(len(w) <= packing.LONG_WORD for w in e.words) and len(e.words) < 5000
    monkeypatch.setattr(e, "whole", list)  # of no texts
    monkeypatch.setattr(e, "letters", None)
    latin = [i for i in range(304) if "<|" not in texts[i]]
    assert len(latin) > 250 and e.encode([texts[i] for i in latin]) == [want[i] for i in latin]

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tertulia.llm import packing
from tests.llm.cases import documents, odd_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_encoder_gives_the_ids_of_the_tokenizers_library(tokenizer):
    encode = packing.load_encoder(RANKS)
    rng = random.Random(1)
    letters = "ab 1\n\t'sé!#　\xa0 \x1c中😀ǅ²<|endoftext|>"
    for text in ["", "<|endoftext|>", "a" * 20_000, " " * 20_000] + ["".join(rng.choices(letters, k=30)) for _ in range(3000)]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def as_loaded():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer_as_loaded(as_loaded):
    encode = packing.load_tokenizer(RANKS)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", "<|endoftext|>", " ", "  ", "\n", "a", " b", "é", "😀", "'s", "12"]
    for text in ["", "first part<|endoftext|>second part"] + ["".join(rng.choices(parts, k=12)) for _ in range(3000)]:
        assert encode(text) == as_loaded.encode(text, add_special_tokens=False).ids


def test_pieces_of_texts_with_the_added_token(spark, as_loaded):
    rows = [(1, "first part<|endoftext|>second part"), (2, "<|endoftext|>"), (3, "a <|endoftext|> b " * 700)]
    pieces = packing.pack(documents(spark, rows).coalesce(1), RANKS).collect()
    check(rows, pieces, as_loaded, 1024)
    assert {p["doc_tokens"] for p in pieces if p["doc_id"] == 1} == {6}


def slow_best_fit(lengths, capacity):
    windows = []
    for n in sorted(lengths, reverse=True):
        rooms = [capacity - sum(w) for w in windows]
        fitting = [r for r in rooms if r >= n]
        if fitting:
            windows[rooms.index(min(fitting))].append(n)
        else:
            windows.append([n])
    return sorted(sum(w) for w in windows)


@pytest.mark.parametrize("capacity", [8, 100, 1024])
def test_segment_tree_finds_the_tightest_window(capacity):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, capacity) for _ in range(300)]
    pieces = [packing.Piece(i, 0, np.zeros(n, "<u4"), n) for i, n in enumerate(lengths)]
    windows = packing.best_fit_decreasing(pieces, capacity)
    assert sorted(map(packing.tokens_in, windows)) == slow_best_fit(lengths, capacity)
    filled = packing.fill_up(windows, capacity, 0)
    assert sorted(packing.tokens_in(w) for w in filled)[1:] == [capacity] * (len(filled) - 1)
    assert sum(map(packing.tokens_in, filled)) == sum(lengths)


def check(rows, pieces, tokenizer, capacity):
    want = sorted(tuple(ids_of(tokenizer, r[1])) for r in rows)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own]).tolist()
        assert [p["offset"] for p in own] == [0, *ends[:-1]]
        assert ends[-1] <= capacity
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    known = {}
    for ids in want:
        known.setdefault(len(ids), []).append(np.array(ids, "<u4"))
    for p in pieces:
        crcs = [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for ids in known[p["doc_tokens"]]]
        assert p["ids_crc32"] in crcs
    return sequences


def test_pieces(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(900)))) for i in range(200)]
    pieces = packing.pack(documents(spark, rows).coalesce(1), RANKS).collect()
    sequences = check(rows, pieces, tokenizer, 1024)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == by_doc.get(p["doc_id"], 0)
        by_doc[p["doc_id"]] = p["start"] + p["length"]
    padding = sum(1024 - sum(p["length"] for p in own) for own in sequences.values())
    assert padding <= max(1023, 0.005 * sum(by_doc.values()))


def test_small_pool_loses_nothing(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, "a b c " * rng.randrange(1, 300)) for i in range(120)]
    pieces = packing.pack(documents(spark, rows).coalesce(2), RANKS, capacity=512, pool=16).collect()
    check(rows, pieces, tokenizer, 512)


def test_odd_rows(spark, tokenizer):
    rows = odd_rows()
    pieces = packing.pack(documents(spark, rows), RANKS).collect()
    check(rows, pieces, tokenizer, 1024)
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)


def test_no_rows(spark):
    assert packing.pack(documents(spark, []), RANKS).count() == 0

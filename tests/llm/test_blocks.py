import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tertulia.llm import backoff, blocks

NUMBERS = st.integers(0, 2**64 - 1) | st.integers(0, 300)
COLUMNS = st.lists(st.lists(NUMBERS, max_size=40), max_size=5)


@given(COLUMNS)
@settings(max_examples=100, deadline=None)
def test_columns_come_back(columns):
    arrays = [np.array(c, "u8") for c in columns]
    assert [c.tolist() for c in blocks.unpack(blocks.pack(arrays))] == columns


@given(st.lists(st.tuples(NUMBERS, NUMBERS, NUMBERS), max_size=60))
@settings(max_examples=100, deadline=None)
def test_codes_come_back(rows):
    few = [tuple(c if c >= backoff.RARE else c % 1_000_000 for c in row) for row in rows]
    codes = [np.array(c, "u8") for c in zip(*few, strict=True)] or [np.zeros(0, "u8")] * 3
    back = backoff.without_escapes(blocks.unpack(blocks.pack(backoff.with_escapes(codes))))
    assert [c.tolist() for c in back] == [c.tolist() for c in codes]


@given(st.lists(NUMBERS, max_size=60), st.integers(1, blocks.MOST_BITS))
@settings(max_examples=100, deadline=None)
def test_blocks_hold_each_ngram_once_in_its_bucket(values, bits):
    codes = [np.array([v % 1000 for v in values], "u8"), np.array([v | backoff.RARE if v % 3 else v % 7 for v in values], "u8")]
    grams = backoff.hashes_of(codes)
    found = []
    for bucket, block in backoff.sent(grams, codes, [np.arange(len(values), dtype="u8")], bits):
        at, *rest = blocks.unpack(block)
        hashes = backoff.hashes_of(backoff.without_escapes(rest))
        assert set((hashes >> np.uint64(64 - bits)).tolist()) == {bucket}
        assert hashes.tolist() == grams[at.astype("i8")].tolist()
        found += at.tolist()
    assert sorted(found) == list(range(len(values)))


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_sums(rows):
    keys, n = (np.array(c, "u8") for c in (zip(*rows, strict=True) if rows else ([], [])))
    found, at, (total,) = blocks.summed(keys, n)
    expected = {k: sum(x for y, x in rows if y == k) for k, _ in rows}
    assert dict(zip(found.tolist(), total.tolist(), strict=True)) == expected
    assert keys[at].tolist() == found.tolist() == sorted(expected)
    found, at, times = blocks.counts_of(keys)
    assert keys[at].tolist() == found.tolist() == sorted(expected)
    assert times.tolist() == [sum(k == x for x, _ in rows) for k in found.tolist()]


def test_more_places_have_more_buckets():
    assert blocks.bits_for(0) == 1
    assert blocks.bits_for(10**8) > blocks.bits_for(10**7)
    assert blocks.bits_for(10**18) == blocks.MOST_BITS

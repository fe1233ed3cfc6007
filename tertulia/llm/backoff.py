"""Language-model scores from a weighted backoff automaton.

Smoothed n-grams become a weighted automaton: states are contexts, an arc adds the log-probability of a
token after its context and leads to the longest context known then, and a failure arc adds a backoff
weight and leads to the context without its first token. A document is scored in one walk from left to
right.

Every n-gram that occurs LEAST times in training is in the model, whatever the size of the corpus. The
automaton must fit in every task, so it holds only the 200,000 most frequent tokens, and the n-grams that
make up at least a fixed share of all tokens: a share of 1e-5 bounds them at 100,000 of each length. All
rarer ones are in a table. The score of
a text is the sum, over all places, of one weight for each known n-gram that begins there: what its arc
adds to the probability after the shorter context, and its backoff weight, which every place after it
passes or its arc takes back. So a walk needs the exact backoff weights of its own states alone, and the
weights of rarer n-grams are added where they meet. They are rare by definition, so no key is hot there.

N-grams travel in blocks: a task sorts those it has read by bucket, the leading bits of their hash, and sends
their codes compressed. The buckets of n-grams, and of what is known of them, meet in one task each, and the
more tokens there are the more buckets. A place of a document travels once for all n-grams that begin
there, to the bucket of the shortest that the automaton lacks, since longer ones are rarer still. What n-grams
weigh is found in the same way: they meet the n-grams of one token less in the bucket of their suffix, and
then in that of their context, still as blocks.

An n-gram goes by a hash of 64 bits, a polynomial of hashes of its tokens. Among three billion n-grams one pair in four such corpora is expected to
share a hash.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.llm.blocks import bits_for, bucket_of, counts_of, pack, rising, runs, summed, unpack
from tertulia.llm.words import lower_words
from tertulia.plans.staging import discard, settle

END = b""  # no word is empty
DISCOUNT = 0.75
PSEUDO = 0.1
LEAST = 2  # n-grams that occur less often are not learned
OF_KNOWN, OF_DOCUMENTS = -1, 0  # kinds of blocks; those from 1 on hold n-grams of so many tokens
OF_FIRST, OF_SHORTER, OF_SUMS, OF_STATES = -2, -3, -4, -5  # others that `weighed` makes
FLUSH = 400_000  # different tokens or n-grams that a task holds before it passes its counts on


RARE = 1 << 63  # codes from here on are hashes of tokens, those below are numbers of frequent ones
BASE = 0x9E3779B97F4A7C17  # 3 modulo 4, so that swapped tokens do not share hashes


def tokens(text: str | None) -> list[bytes]:
    return [*lower_words(text), END]


class Codes(dict):
    """Codes of tokens: the number of a frequent one, a hash of any other."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) | RARE

    def of(self, words: list[bytes]) -> list[int]:
        return list(map(self.__getitem__, words))


def mixed(codes: np.ndarray) -> np.ndarray:
    """Hashes of tokens from their codes; different codes have different hashes."""
    x = codes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one token more, by its code."""
    return hashes * np.uint64(BASE) + mixed(last)


def grams_of(codes: np.ndarray, doc: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to `order`, the hashes of the n-grams that lie within one document, and the
    places where they begin. `doc` numbers the document of each code."""
    hashes = mixed(codes)
    yield hashes, np.arange(len(codes))
    for k in range(2, order + 1):
        if len(codes) < k:
            return
        hashes = longer(hashes[:-1], codes[k - 1 :])
        within = np.flatnonzero(doc[: len(hashes)] == doc[k - 1 :])
        yield hashes[within], within


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view("int64"), pa.int64())


@dataclass
class Automaton:
    """States by number, 0 being the initial one, which has an arc for every token in `numbers`.

    first_next, first_weight   the arcs of the initial state, by token number
    arcs                       for each other state, token number to (next state, weight)
    failure, backoff           for each state, where it goes on without an arc, and at which weight
    """

    numbers: dict[bytes, int]
    first_next: array
    first_weight: array
    arcs: list[dict[int, tuple[int, float]]]
    failure: list[int]
    backoff: list[float]

    def walk(self, codes: list[int]) -> tuple[float, float, int]:
        """Sum of all weights passed, sum of the weights that the initial state has for the same tokens,
        and how many tokens are in the automaton."""
        arcs, failure, backoff = self.arcs, self.failure, self.backoff
        first_next, first_weight = self.first_next, self.first_weight
        state, total, plain, known = 0, 0.0, 0.0, 0
        for token in codes:
            if token >= RARE:
                while state:
                    total += backoff[state]
                    state = failure[state]
                continue
            known += 1
            weight = first_weight[token]
            plain += weight
            while state:
                arc = arcs[state].get(token)
                if arc is not None:
                    state, weight = arc
                    break
                total += backoff[state]
                state = failure[state]
            else:
                state = first_next[token]
            total += weight
        return total, plain, known

    @staticmethod
    def build(
        numbers: dict[bytes, int],
        unigrams: list[float],
        ngrams: dict[tuple[int, ...], int],
        counts: list[int],
        left: dict[tuple[int, ...], float],
    ) -> Automaton:
        """From probabilities of single tokens, counts of longer n-grams, and the logarithms of what each
        context leaves to tokens that are not known after it (see `weights`).

        The contexts of `left` are the states. A known n-gram has probability (count - DISCOUNT) / count
        of its context. What is left goes to all other tokens in proportion to their probability after
        the shorter context, so that the probabilities after each context add up to one.
        """
        contexts: dict[tuple[int, ...], dict[int, int]] = {}
        for gram, n in ngrams.items():
            contexts.setdefault(gram[:-1], {})[gram[-1]] = n
        ordered = sorted(left, key=lambda c: (len(c), c))
        state = {(): 0} | {c: i + 1 for i, c in enumerate(ordered)}

        def known(context: tuple[int, ...]) -> int:
            while context not in state:
                context = context[1:]
            return state[context]

        made = Automaton(
            numbers,
            array("i", [known((t,)) for t in range(len(unigrams))]),
            array("d", map(math.log10, unigrams)),
            [{}],
            [0],
            [0.0],
        )
        nothing: dict[int, tuple[int, float]] = {}
        for context in ordered:
            of_context = counts[context[0]] if len(context) == 1 else ngrams[context]
            after = contexts.get(context, {})
            arcs = {t: (known((*context, t)), math.log10((n - DISCOUNT) / of_context)) for t, n in after.items()}
            made.arcs.append(arcs or nothing)
            made.failure.append(known(context[1:]))
            made.backoff.append(left[context])
        return made


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each token occurs: token, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(tokens(value.as_py()))
                if len(seen) > FLUSH:
                    yield _rows(seen)
                    seen.clear()
        yield _rows(seen)

    def _rows(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"]
        )

    return docs.select(text).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def in_groups(batches: Iterator[pa.RecordBatch], column: int, codes: Codes) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Slices of the batches of about FLUSH tokens or one document, with the codes of each document."""
    for batch in batches:
        first, held, found = 0, 0, []
        for i, value in enumerate(batch.column(column)):
            found.append(codes.of(tokens(value.as_py())))
            held += len(found[-1])
            if held > FLUSH or i == len(batch) - 1:
                yield batch.slice(first, len(found)), found
                first, held, found = i + 1, 0, []


def joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of some documents in one array, and which document each is of."""
    lengths = [len(f) for f in found]
    flat = np.fromiter(chain.from_iterable(found), "uint64", sum(lengths))
    return flat, np.repeat(np.arange(len(found)), lengths)


def with_escapes(codes: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of codes as small numbers, 0 for the hash of a rare token, and then all these hashes."""
    rare = [c >= np.uint64(RARE) for c in codes]
    small = [np.where(r, np.uint64(0), c + np.uint64(1)) for c, r in zip(codes, rare, strict=True)]
    return [*small, np.concatenate([c[r] for c, r in zip(codes, rare, strict=True)])]


def without_escapes(columns: list[np.ndarray]) -> list[np.ndarray]:
    *small, hashes = columns
    codes, at = [], 0
    for column in small:
        rare = column == 0
        code, end = column - np.uint64(1), at + int(rare.sum())
        code[rare] = hashes[at:end]
        codes.append(code)
        at = end
    return codes


def hashes_of(codes: list[np.ndarray]) -> np.ndarray:
    hashes = mixed(codes[0])
    for code in codes[1:]:
        hashes = longer(hashes, code)
    return hashes


def sent(grams: np.ndarray, codes: list[np.ndarray], others: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of n-grams by the bucket of their hash. Within a bucket they are in order of their first
    two tokens, as far as these have numbers, so that like ones lie side by side."""
    near = np.uint64((1 << 21) - 1)
    key = bucket_of(grams, bits) << np.uint64(42)
    for code, shift in zip(codes[:2], (21, 0), strict=False):
        key |= np.minimum(code, near) << np.uint64(shift)
    order = np.argsort(key)
    del key
    columns, hashes = [c[order] for c in others], []
    for code in codes:
        code = code[order]
        rare = np.flatnonzero(code >= np.uint64(RARE))
        hashes.append((code[rare], rare))
        code += np.uint64(1)
        code[rare] = 0
        columns.append(code)
    compressor = zstandard.ZstdCompressor(level=1)
    for bucket, start, end in runs(bucket_of(grams[order], bits)):
        own = np.concatenate([found[slice(*np.searchsorted(at, (start, end)))] for found, at in hashes])  # as `with_escapes` has them
        yield bucket, pack([*(c[start:end] for c in columns), own], compressor)


def look_up(table: np.ndarray, searched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the value is there."""
    if not len(table):
        return np.zeros(len(searched), "i8"), np.zeros(len(searched), bool)
    at = np.minimum(np.searchsorted(table, searched), len(table) - 1)
    return at, table[at] == searched


def by_bucket(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of batches that are in order of their buckets, each with all rows of one bucket."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    for _, group in groupby(rows, itemgetter(0)):
        yield group


BLOCK = "bucket long, kind byte, block binary"


def block_rows(buckets: list[int], kinds: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), pa.array(kinds, pa.int8()), pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"]
    )


def dealt(blocks: DataFrame) -> DataFrame:
    """All blocks of a bucket in one task, in order of their kinds."""
    return blocks.repartition("bucket").sortWithinPartitions("bucket", "kind")


def with_codes(parts: list[list[np.ndarray]], others: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of several blocks that `sent` made: others, and codes."""
    whole = [[*part[:others], *without_escapes(part[others:])] for part in parts]
    columns = [np.concatenate(c) for c in zip(*whole, strict=True)]
    return columns[:others], columns[others:]


def count_ngrams(training: DataFrame, numbers: dict[bytes, int], order: int, least: float, places: int) -> DataFrame:
    """N-grams of two tokens or more that occur at least `least` times, in blocks of their counts and codes;
    the kind of a block is the number of tokens.

    Tasks count what they read and send the codes of different n-grams in blocks, a block for each bucket
    of hashes; the buckets, of which there are more the more `places`, are added up one at a time."""
    bound = training.sparkSession.sparkContext.broadcast(numbers)
    bits = bits_for(places)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(bound.value)
        chunks: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for _, found in in_groups(batches, 0, codes):
            chunks.append(joined(found))
            held += len(chunks[-1][0])
            if held > 2 * FLUSH:
                yield from _rows(chunks)
                chunks, held = [], 0
        yield from _rows(chunks)

    def _rows(chunks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not chunks:
            return
        flat = np.concatenate([c for c, _ in chunks])
        docs = np.cumsum([0, *(d[-1] + 1 for _, d in chunks)])
        doc = np.concatenate([d + first for (_, d), first in zip(chunks, docs, strict=False)])
        for k, (grams, places) in enumerate(grams_of(flat, doc, order), 1):
            if k > 1 and len(grams):
                grams, at, n = counts_of(grams)
                places = places[at]
                buckets, blocks = zip(*sent(grams, [flat[places + i] for i in range(k)], [n], bits), strict=True)
                yield block_rows(buckets, [k] * len(blocks), blocks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bucket(batches, ["bucket", "kind", "block"]):
            for k, level in groupby(group, itemgetter(1)):
                (n,), codes = with_codes([unpack(block) for _, _, block in level], 1)
                grams, at, (n,) = summed(hashes_of(codes), n)
                often = n >= least
                for bucket, block in sent(grams[often], [c[at[often]] for c in codes], [n[often]], bits):
                    yield block_rows([bucket], [k], [block])

    return dealt(training.select("text").mapInArrow(count, BLOCK)).mapInArrow(add, BLOCK)


def singles(counts: DataFrame, numbers: dict[bytes, int], bits: int) -> DataFrame:
    """Tokens without a number as what is known of n-grams of one token, all with a weight of 0."""
    bound = counts.sparkSession.sparkContext.broadcast(numbers)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, out = bound.value, Outgoing(bits, bits)
        for batch in batches:
            words = [(Codes().__missing__(w), n) for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if w not in numbers]
            codes, n = (np.array(c, "u8") for c in (zip(*words, strict=True) if words else ((), ())))
            grams = mixed(codes)
            out.add(OF_KNOWN, grams, grams, n, np.zeros(len(n)))
            yield from out.full()
        yield from out.all()

    return counts.select("token", "n").mapInArrow(code, BLOCK)


class Outgoing:
    """What a task makes of n-grams, by kind: passed on in blocks, by buckets of its keys, after every FLUSH rows or so."""

    def __init__(self, bits: int, final_bits: int):
        self.bits, self.final_bits, self.held, self.size = bits, final_bits, {}, 0

    def add(self, kind: int, keys: np.ndarray, *columns: np.ndarray) -> None:
        if len(keys):
            self.held.setdefault(kind, []).append((keys, *(c.view("u8") for c in columns)))
            self.size += len(keys)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > FLUSH:
            yield from self.all()

    def all(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            keys, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
            if kind == OF_SUMS:
                first, _, sums = summed(columns[0], *(c.view("f8") for c in columns[1:]))
                made = [(0, pack([first, *(c.view("u8") for c in sums)]))]
            elif kind == OF_STATES:
                made = [(0, pack(columns))]
            elif kind > 0:
                made = list(sent(keys, columns[-kind:], columns[:-kind], self.bits))
            else:
                bucket = bucket_of(keys, self.bits if kind == OF_SHORTER else self.final_bits)
                order = np.lexsort((columns[0], bucket))
                grams, *others = (c[order] for c in columns)
                compressor = zstandard.ZstdCompressor(level=1)
                made = [(b, pack([rising(grams[i:j]), *(c[i:j] for c in others)], compressor)) for b, i, j in runs(bucket[order])]
            buckets, blocks = zip(*made, strict=True)
            yield block_rows(buckets, [kind] * len(blocks), blocks)
        self.held, self.size = {}, 0


def table_of(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """What blocks say of n-grams, in order of their hashes; blocks that `Outgoing` made."""
    if not parts:
        return [np.zeros(0, "u8")] * 3
    grams, *columns = (np.concatenate(c) for c in zip(*([np.cumsum(g, dtype="u8"), *rest] for g, *rest in parts), strict=True))
    order = np.argsort(grams)
    return [grams[order], *(c[order] for c in columns)]


def route_of(codes: list[np.ndarray], held: np.ndarray) -> np.ndarray:
    """Hash of the shortest prefix that the automaton lacks, or else of the whole n-gram."""
    hashes = mixed(codes[0])
    route, open_ = hashes.copy(), codes[0] < np.uint64(RARE)
    for code in codes[1:]:
        hashes = longer(hashes, code)
        route[open_] = hashes[open_]
        open_ &= look_up(held, hashes)[1]
    return route


def weighed(ngrams: DataFrame, shorter: DataFrame, k: int, last: bool, model, bits: int, final_bits: int) -> DataFrame:
    """From counted n-grams of `k` tokens and what is known of those with one token less, in blocks of kind

    OF_KNOWN     by route, gram, tokens seen, weight: the logarithm of an n-gram's probability over what it has
                 by backing off; and of contexts, the logarithm of what is left for tokens not known after
                 them over what these have after the shorter context
    OF_FIRST     gram, number of its first token, weight before what that token leaves: bigrams of numbered tokens
    OF_SUMS      for what a numbered token leaves: number, sums of the probabilities of its bigrams and of their ends
    OF_STATES    what is left after a context that the automaton holds, and its codes
    OF_SHORTER   gram, n, n of its context: of all, for the next length

    N-grams go to the bucket of their suffix, for its probability, and then to that of their context. Numbered
    tokens are known everywhere, so their bigrams need not meet and are dealt by their own hash.
    """

    def rare(codes: np.ndarray) -> np.ndarray:
        return codes >= np.uint64(RARE)

    def n_of(codes: list[np.ndarray], table: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often shorter n-grams and their contexts occur; single tokens have no context."""
        at, hit = look_up(table[0], hashes_of(codes))
        n, of_context = ((c[at] if len(c) else at.astype("u8")) for c in table[1:])
        if k == 2:
            numbered = ~rare(codes[0])
            n = n.copy()
            n[numbered] = times[codes[0][numbered].astype("i8")]
        return n, of_context

    def by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outgoing(bits, final_bits)
        for batch in batches:
            for block in batch.column(0):
                (n,), codes = with_codes([unpack(block.as_py())], 1)
                key = hashes_of(codes[1:])
                if k == 2:
                    key = np.where(rare(codes[1]), key, hashes_of(codes))
                out.add(k, key, n, *codes)
                yield from out.full()
        yield from out.all()

    def by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, (times, _, below, _) = Outgoing(bits, final_bits), model.value
        for group in by_bucket(batches, ["bucket", "kind", "block"]):
            blocks = {kind: [unpack(b) for _, _, b in of_kind] for kind, of_kind in groupby(group, itemgetter(1))}
            if k in blocks:
                (n,), codes = with_codes(blocks.pop(k), 1)
                n_shorter, of_shorter = n_of(codes[1:], table_of([p for parts in blocks.values() for p in parts]), times)
                p_shorter = (n_shorter + PSEUDO) / below if k == 2 else (n_shorter - DISCOUNT) / of_shorter
                key = hashes_of(codes[:-1])
                if k == 2:
                    key = np.where(rare(codes[0]), key, hashes_of(codes))
                out.add(k, key, n, p_shorter, *codes)
                yield from out.full()
        yield from out.all()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, (times, held, _, from_grams) = Outgoing(bits, final_bits), model.value
        nothing = [np.zeros(0, "u8")]
        for group in by_bucket(batches, ["bucket", "kind", "block"]):
            blocks = {kind: [unpack(b) for _, _, b in of_kind] for kind, of_kind in groupby(group, itemgetter(1))}
            (n, p_shorter), codes = with_codes(blocks.pop(k, [nothing * (k + 3)]), 2)
            p_shorter = p_shorter.view("f8")
            table = table_of([p for parts in blocks.values() for p in parts])
            of_context, _ = n_of(codes[:-1], table, times)
            context = hashes_of(codes[:-1])
            gram = longer(context, codes[-1])
            p = (n - DISCOUNT) / of_context
            weight = np.log10(p) - np.log10(p_shorter)
            if not last:
                out.add(OF_SHORTER, gram, gram, n, of_context)
            here = rare(codes[0]) if k == 2 else np.ones(len(gram), bool)
            if not here.all():
                there = ~here
                first = codes[0][there]
                out.add(OF_FIRST, gram[there], gram[there], first, weight[there])
                first, _, sums = summed(first, p[there], p_shorter[there])
                out.add(OF_SUMS, first, first, *sums)
            own, context, codes = weight[here], context[here], [c[here] for c in codes]
            contexts, at, (known, known_shorter) = summed(context, p[here], p_shorter[here])
            left = np.log10(np.maximum(1 - known, 1e-12) / np.maximum(1 - known_shorter, 1e-12))
            if len(own):
                own = own - left[np.searchsorted(contexts, context)]
            gram = gram[here]
            out.add(OF_KNOWN, route_of(codes, held), gram, np.zeros(len(gram), "u8"), own)
            if k == 2:
                to, hit = look_up(contexts, table[0])
                out.add(OF_KNOWN, table[0], table[0], table[1], np.where(hit, left[to], 0.0) if len(left) else np.zeros(len(hit)))
            else:
                of = [c[at] for c in codes[:-1]]
                out.add(OF_KNOWN, route_of(of, held), contexts, np.zeros(len(at), "u8"), left)
                states = of_context[here][at] >= from_grams
                out.add(OF_STATES, contexts[states], left[states], *(c[states] for c in of))
            yield from out.full()
        yield from out.all()

    suffixes = ngrams.where(F.col("kind") == k).select("block").mapInArrow(by_suffix, BLOCK).unionByName(shorter)
    contexts = dealt(suffixes).mapInArrow(by_context, BLOCK).unionByName(shorter)
    return dealt(contexts).mapInArrow(weigh, BLOCK)


def often(ngrams: DataFrame, least: float) -> DataFrame:
    """Of counted n-grams, blocks of those that occur at least `least` times."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (n,), codes = with_codes([unpack(block)], 1)
                chosen = n >= least
                if chosen.any():
                    yield block_rows([bucket], [kind], [pack([n[chosen], *with_escapes([c[chosen] for c in codes])])])

    return ngrams.mapInArrow(choose, BLOCK)


def summed_up(level: DataFrame) -> DataFrame:
    """Numbered tokens with what `weighed` found in sum of their bigrams: first, known, shorter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                first, *sums = unpack(block.as_py())
                yield pa.RecordBatch.from_arrays([signed(first), *(pa.array(c.view("f8")) for c in sums)], names=["first", "known", "shorter"])

    found = level.where(F.col("kind") == OF_SUMS).select("block").mapInArrow(rows, "first long, known double, shorter double")
    return found.groupBy("first").agg(F.sum("known").alias("known"), F.sum("shorter").alias("shorter"))


def held_out(doc_id: str = "doc_id"):
    """One document in ten, by the CRC-32 of its id as text; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(
    docs: DataFrame,
    order: int = 3,
    token_share: float = 0.0,
    ngram_share: float = 0.0,
    held_share: float = 1e-5,
    held_tokens: int = 200_000,
) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that are not held out and scores all. Tokens are the words of the whole
    text, A-Z lower-cased, and one end; a missing or empty text is the end alone. `base_score` takes
    each token by itself, (c + 0.1) / (N + 0.1 (V + 1)) for a count of c among N training tokens, V of
    them different; `score` is the automaton's log10 probability, whose initial state has the same
    weights. Equal rows give equal rows, each of its own, also without a doc_id; without any training
    document all counts are zero; no rows give no rows; other columns are ignored.

    All n-grams that occur LEAST times are learned; a `ngram_share` above zero leaves out those below
    that share of the training tokens. The automaton holds tokens and n-grams from the shares `token_share`
    and `held_share` on, and of tokens the `held_tokens` most frequent at most; all others are joined. This
    bounds its size and changes no score.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    training = read.where("not held_out").select("text")
    counts = settle(counted(training))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = n + PSEUDO * (v + 1)
    least = max(ngram_share * n, LEAST)
    beyond = counts.orderBy(F.desc("n")).select("n").offset(held_tokens).first()
    from_tokens = max(token_share * n, beyond.n + 1 if beyond else 0)
    from_grams = max(held_share * n, from_tokens)

    common = counts.where(F.col("n") >= from_tokens).orderBy(F.desc("n"), "token").toArrow()
    numbers = {w: i for i, w in enumerate(common.column("token").to_pylist())}
    by_number = common.column("n").to_pylist()
    context = docs.sparkSession.sparkContext
    bits = bits_for(2 * n)
    known = singles(counts, numbers, bits)
    levels: list[DataFrame] = []
    frequent: dict[tuple[int, ...], int] = {}
    left: dict[tuple[int, ...], float] = {}
    held = np.zeros(0, "u8")
    first_left = np.zeros(len(numbers))
    if order > 1:
        ngrams = settle(count_ngrams(training, numbers, order, least, n))
        for block in often(ngrams, from_grams).toArrow().column("block").to_pylist():
            times, *rest = unpack(block)
            frequent |= dict(zip(zip(*(c.tolist() for c in without_escapes(rest)), strict=True), times.tolist(), strict=True))
        for _, of_length in groupby(sorted(frequent, key=len), len):
            codes = [np.array(c, "u8") for c in zip(*of_length, strict=True)]
            held = np.append(held, hashes_of(codes))
        held.sort()
        model = context.broadcast((np.array(by_number, "u8"), held, below, from_grams))
        level_bits = bits_for(n // 4)
        shorter = known if level_bits == bits else singles(counts, numbers, level_bits)
        for k in range(2, order + 1):
            levels.append(settle(weighed(ngrams, shorter, k, k == order, model, level_bits, bits)))
            shorter = levels[-1].where(F.col("kind") == OF_SHORTER)
            if k > 2:  # nothing reads the shorter ones any more
                whole = levels[-2]
                levels[-2] = settle(whole.where(F.col("kind") != OF_SHORTER))
                discard(whole)
        discard(ngrams)
        sums = summed_up(levels[0]).toArrow()
        first = sums.column("first").to_numpy()
        first_left[first] = np.log10(
            np.maximum(1 - sums.column("known").to_numpy(), 1e-12) / np.maximum(1 - sums.column("shorter").to_numpy(), 1e-12)
        )
        left |= {(u,): first_left[u].item() for u in first.tolist()}
        for level in levels[1:]:
            for block in level.where(F.col("kind") == OF_STATES).select("block").toArrow().column("block").to_pylist():
                found, *codes = unpack(block)
                left |= dict(zip(zip(*(c.tolist() for c in codes), strict=True), found.view("f8").tolist(), strict=True))
        discard(counts)
        known = functools.reduce(DataFrame.unionByName, levels).where(F.col("kind").isin(OF_KNOWN, OF_FIRST))
    automaton = Automaton.build(numbers, [(c + PSEUDO) / below for c in by_number], frequent, by_number, left)
    bound = context.broadcast((tuple(vars(automaton).values()), held))
    of_first = context.broadcast(first_left)
    absent = np.uint64(len(numbers))  # the code of no token, after the end of a document

    def rows_from(first: int, made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """Blocks with the number of their first document."""
        buckets, kinds, blocks = zip(*made, strict=True)
        rows = block_rows(buckets, kinds, blocks)
        return rows.append_column("first", pa.array([first] * len(made), pa.int64()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = bound.value
        automaton = Automaton(*parts)
        first = TaskContext.get().partitionId() << 33
        chunks: list[list[np.ndarray]] = []
        own: list[list[np.ndarray]] = []
        size = rows = 0
        for batch, found in in_groups(batches, 2, Codes(automaton.numbers)):
            totals, plain, known = zip(*map(automaton.walk, found), strict=True)
            doc_id = batch.column(0)
            flat, of_row = joined(found)
            own.append(
                [
                    doc_id.fill_null(0).to_numpy().view("u8"),
                    doc_id.is_valid().to_numpy(zero_copy_only=False).astype("u8"),
                    batch.column(1).to_numpy(zero_copy_only=False).astype("u8"),
                    np.array([len(f) for f in found], "u8"),
                    np.array(known, "u8"),
                    np.array(plain, "f8").view("u8"),
                    np.array(totals, "f8").view("u8"),
                ]
            )
            chunks.append([flat, of_row + rows])
            size, rows = size + len(flat), rows + len(found)
            if size > FLUSH:
                yield _blocks(chunks, own, first, held)
                first += rows
                chunks, own, size, rows = [], [], 0, 0
        if rows:
            yield _blocks(chunks, own, first, held)

    def _blocks(chunks: list[list[np.ndarray]], own: list[list[np.ndarray]], first: int, held: np.ndarray) -> pa.RecordBatch:
        # The rows of documents are no n-grams; this hash deals them out.
        made = [(int(mixed(np.array([first], "u8"))[0]) >> (64 - bits), OF_DOCUMENTS, pack([np.concatenate(c) for c in zip(*own, strict=True)]))]
        flat, of_row = (np.concatenate(c) for c in zip(*chunks, strict=True))
        left = np.ones(len(flat), bool)
        for k, (grams, places) in enumerate(grams_of(flat, of_row, order), 1):
            # A place goes to the bucket of the shortest n-gram that the automaton lacks, see `route_of`.
            chosen = flat >= np.uint64(RARE) if k == 1 else left[places] & ~look_up(held, grams)[1]
            left[places[chosen]] = False
            grams, places = grams[chosen], places[chosen]
            rows = of_row[places]
            codes = [flat[places + i] for i in range(k)]
            for i in range(k, order):
                at = np.minimum(places + i, len(flat) - 1)
                codes.append(np.where((places + i == at) & (of_row[at] == rows), flat[at], absent))
            made += [(bucket, k, block) for bucket, block in sent(grams, codes, [rows.astype("u8")], bits)]
        return rows_from(first, made)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[np.ndarray, ...]] = []
        size = 0
        for group in by_bucket(batches, ["bucket", "kind", "first", "block"]):
            parts: list[tuple[np.ndarray, ...]] = []
            grams, seen, weights = np.zeros(0, "u8"), np.zeros(1, "u8"), np.zeros(1)
            for kind, of_kind in groupby(group, itemgetter(1)):
                if kind < 0:
                    for _, _, _, block in of_kind:
                        gram, times, weight = unpack(block)
                        gram, weight = np.cumsum(gram, dtype="u8"), weight.view("f8")
                        if kind == OF_FIRST:
                            weight = weight - of_first.value[times.astype("i8")]
                            times = np.zeros(len(times), "u8")
                        parts.append((gram, times, weight))
                    continue
                if parts:
                    grams, _, (seen, weights) = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    parts = []
                if kind == OF_DOCUMENTS:
                    for _, _, start, block in of_kind:
                        yield _documents(start, unpack(block))
                    continue
                for row, *codes in _gathered(of_kind):
                    searched = hashes_of(codes[:kind])
                    at, hit = look_up(grams, searched)
                    any_hit, weight = hit, np.where(hit, weights[at], 0.0)
                    times = np.where(hit, seen[at], 0) if kind == 1 else None
                    for code in codes[kind:]:
                        searched = longer(searched, code)
                        at, hit = look_up(grams, searched)
                        hit &= code != absent
                        weight[hit] += weights[at[hit]]
                        any_hit = any_hit | hit
                    if kind == 1:
                        plain = np.log10((times + PSEUDO) / below)
                        found, _, of = summed(row, (times > 0).astype("i8"), plain, plain + weight)
                    else:
                        found, _, (added,) = summed(row[any_hit], weight[any_hit])
                        of = [np.zeros(len(found), "i8"), np.zeros(len(found)), added]
                    sums.append((found, *of))
                    size += len(found)
                if size > 2 * FLUSH:
                    sums = [_merged(sums)]
                    size = len(sums[0][0])
                    if size > FLUSH:
                        yield _sums(sums)
                        sums, size = [], 0
        if sums:
            yield _sums([_merged(sums)])

    def _gathered(of_kind: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
        """Rows of documents and codes of many blocks at a time, which are small."""
        parts, size = [], 0
        for _, _, start, block in of_kind:
            row, *rest = unpack(block)
            parts.append([row.view("i8") + start, *without_escapes(rest)])
            size += len(row)
            if size > FLUSH // 4:
                yield [np.concatenate(c) for c in zip(*parts, strict=True)]
                parts, size = [], 0
        if parts:
            yield [np.concatenate(c) for c in zip(*parts, strict=True)]

    def _merged(sums: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        row, _, added = summed(*(np.concatenate(c) for c in zip(*sums, strict=True)))
        return row, *added

    def _sums(sums: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ((row, *added),) = sums
        nothing = [pa.nulls(len(row), t) for t in (pa.int64(), pa.bool_(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(row), *nothing, *map(pa.array, added)], names=names)

    def _documents(start: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        doc_id, valid, held_out, n_tokens, known, plain, walked = columns
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(start, start + len(doc_id), dtype="i8")),
                pa.array(doc_id.view("i8"), mask=valid == 0),
                pa.array(held_out == 1),
                pa.array(n_tokens.view("i8")),
                pa.array(known.view("i8")),
                pa.array(plain.view("f8")),
                pa.array(walked.view("f8")),
            ],
            names=names,
        )

    fields = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [f.split()[0] for f in fields.split(", ")]
    places = read.mapInArrow(walk, f"{BLOCK}, first long")
    met = dealt(places.unionByName(known.withColumn("first", F.lit(0).cast("long")))).mapInArrow(meet, fields)
    # An n-gram that is not known adds nothing; it ends in its bucket.
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")

import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tertulia.llm import backoff
from tests.llm.cases import documents, odd_rows


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class ByHand:
    """The same probabilities from their definition, by recursion on the context."""

    def __init__(self, rows, order, token_share, ngram_share):
        self.order = order
        texts = [backoff.tokens(r[1]) for r in rows if not held_out(r[0])]
        self.count = Counter(w for words in texts for w in words)
        self.n = sum(self.count.values())
        self.below = self.n + 0.1 * (len(self.count) + 1)
        known = {(w,) for w, c in self.count.items() if c >= max(token_share, ngram_share) * self.n}
        self.grams = {}
        for k in range(2, order + 1):
            seen = Counter(
                tuple(words[i : i + k])
                for words in texts
                for i in range(len(words) - k + 1)
                if tuple(words[i : i + k - 1]) in known and tuple(words[i + 1 : i + k]) in known
            )
            known = {g for g, c in seen.items() if c >= max(ngram_share * self.n, 2)}
            self.grams |= {g: seen[g] for g in known}
        self.after = {}
        for gram, c in self.grams.items():
            self.after.setdefault(gram[:-1], {})[gram[-1]] = c

    def total(self, context):
        return self.count[context[0]] if len(context) == 1 else self.grams[context]

    @functools.cache  # noqa: B019
    def rest(self, context):
        own = sum((c - 0.75) / self.total(context) for c in self.after[context].values())
        return max(1 - own, 1e-12) / max(1 - sum(self.probability(context[1:], w) for w in self.after[context]), 1e-12)

    def probability(self, context, word):
        if not context:
            return (self.count[word] + 0.1) / self.below
        if word in self.after.get(context, ()):
            return (self.after[context][word] - 0.75) / self.total(context)
        return (self.rest(context) if context in self.after else 1.0) * self.probability(context[1:], word)

    def score(self, text):
        words = backoff.tokens(text)
        return sum(math.log10(self.probability(tuple(words[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(words))

    def base(self, text):
        return sum(math.log10((self.count[w] + 0.1) / self.below) for w in backoff.tokens(text))


def random_rows(n=150):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words, at = [], 0
        for _ in range(rng.randrange(60)):
            at = (at * 3 + 1) % 7 if rng.random() < 0.6 else rng.randrange(40)
            words.append(vocabulary[at] if rng.random() < 0.95 else f"rare{rng.randrange(10**6)}")
        rows.append((i, " ".join(words).title()))
    return rows


@pytest.mark.parametrize(("order", "token_share", "ngram_share"), [(3, 1e-6, 1e-3), (4, 5e-3, 5e-3), (2, 0.9, 0.9), (1, 1e-6, 1e-6)])
def test_scores_equal_their_definition(spark, order, token_share, ngram_share):
    rows = random_rows()
    model = ByHand(rows, order, token_share, ngram_share)
    found = backoff.score(documents(spark, rows).repartition(3), order, token_share, ngram_share).collect()
    assert len(found) == len(rows)
    for r in found:
        text = rows[r["doc_id"]][1]
        words = backoff.tokens(text)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(r["doc_id"]), len(words), model.n)
        assert r["n_known"] == sum(model.count[w] > 0 for w in words)
        assert math.isclose(r["base_score"], model.base(text), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(text), rel_tol=1e-9)


@pytest.mark.parametrize(("order", "shares"), [(3, [5e-3]), (3, [1e-6, 0.0, 2e-2]), (3, [2.0, 0.0, 2.0]), (4, [1e-2, 0.0, 2e-2])])
def test_ngrams_are_learned_from_a_fixed_count_on_whatever_is_held(spark, order, shares):
    rows = [*random_rows(), (150, "rare1 rare2 rare3 w1"), (151, "w1 rare1 rare2 rare3 w1"), (152, "rare1 rare2 rare3 rare3")]
    model = ByHand(rows, order, 0, 0)
    assert (b"rare1", b"rare2") in model.grams
    found = backoff.score(documents(spark, rows).repartition(3), order, *shares).collect()
    assert len(found) == len(rows)
    for r in found:
        words = backoff.tokens(rows[r["doc_id"]][1])
        assert r["n_known"] == sum(model.count[w] > 0 for w in words)
        assert math.isclose(r["base_score"], model.base(rows[r["doc_id"]][1]), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(rows[r["doc_id"]][1]), rel_tol=1e-9)


def test_scores_do_not_depend_on_how_much_a_task_holds(spark, monkeypatch):
    """Tasks pass on their counts and n-grams after every few documents, in many small buckets."""
    rows = random_rows()
    expected = {r["doc_id"]: r["score"] for r in backoff.score(documents(spark, rows)).collect()}
    monkeypatch.setattr(backoff, "FLUSH", 20)
    monkeypatch.setattr(backoff, "bits_for", lambda places: 7)
    for held_tokens in (200_000, 10):
        found = backoff.score(documents(spark, rows).repartition(2), 3, 1e-3, 0.0, 1e-2, held_tokens).collect()
        assert len(found) == len(rows)
        assert all(math.isclose(r["score"], expected[r["doc_id"]], rel_tol=1e-9) for r in found)


def test_ngrams_are_weighed_in_blocks(spark, monkeypatch):
    """No n-gram becomes a row of a join, which took too much memory."""
    plans = []
    settle = backoff.settle
    monkeypatch.setattr(backoff, "settle", lambda df: plans.append(df._jdf.queryExecution().toString()) or settle(df))
    assert backoff.score(documents(spark, random_rows(20))).count() == 20
    assert len(plans) > 3
    assert not any("Join" in plan for plan in plans)


def test_probabilities_add_up_to_one():
    model = ByHand(random_rows(), 3, 1e-6, 1e-3)
    unseen = 0.1 / model.below
    for context in list(model.after)[:20]:
        seen = sum(model.probability(context, w) for w in model.count)
        assert math.isclose(seen + unseen * 10 ** math.log10(model.rest(context)) * (1 if len(context) == 1 else model.rest(context[1:]) if context[1:] in model.after else 1), 1, rel_tol=1e-6)


def test_contexts_help_on_held_out_documents(spark):
    found = backoff.score(documents(spark, random_rows(400)), 3, 1e-6, 1e-3).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found) * 0.9


def test_odd_rows(spark):
    rows = odd_rows()
    model = ByHand(rows, 3, 1e-6, 1e-5)
    found = backoff.score(documents(spark, rows)).collect()
    got = sorted((r["n_tokens"], round(r["score"], 6), round(r["base_score"], 6)) for r in found)
    assert got == sorted((len(backoff.tokens(r[1])), round(model.score(r[1]), 6), round(model.base(r[1]), 6)) for r in rows)


def test_a_place_of_a_rare_token_travels_once():
    """All that begins with it goes to the bucket of the token itself, also its n-grams."""
    rare, often = (np.array([c], "u8") for c in (backoff.RARE | 5, 7))
    held = np.sort(backoff.hashes_of([often, often]))
    assert backoff.route_of([rare, often, often], held) == backoff.mixed(rare)
    assert backoff.route_of([often, rare, often], held) == backoff.hashes_of([often, rare])
    assert backoff.route_of([often, often, rare], held) == backoff.hashes_of([often, often, rare])


def test_no_rows_and_no_training_rows(spark):
    assert backoff.score(documents(spark, [])).count() == 0
    out = next(i for i in range(1000) if held_out(i))
    only = backoff.score(documents(spark, [(out, "a b")])).first()
    assert (only["train_tokens"], only["n_known"], only["n_tokens"]) == (0, 0, 3)
    assert only["score"] == only["base_score"] == 0.0

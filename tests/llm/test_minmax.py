import random
import re

import numpy as np
import pytest

from tertulia.llm import graph, minmax
from tests.llm.cases import documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def top(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a


def by_hand(rows, width, percent):
    """All pairs; needs different ids that are not null."""
    sets = {i: set_of(text, width) for i, text, *_ in rows}
    groups, ids = Groups(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.top(i)) for i in ids}


def copies(seed, groups=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(rng.choice([2, 3, 8, 30, 100, 300]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"Z{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 10_007, rng.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, width, percent):
    rows = copies(width) + [(20_000 + i, t) for i, t in enumerate([None, "", " \n", "a", "A", "a b", "A  b"])]
    found = minmax.find(documents(spark, rows).repartition(3), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_hand(rows, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_chains_of_links(spark):
    """Each text is linked with the next only, so no text is close to most of its group."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)]
    found = minmax.find(documents(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_hand(rows, 3, 85)


def test_texts_that_share_much_but_too_little(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(60)])) for i in range(150)]
    found = minmax.find(documents(spark, rows), 3, 85).collect()
    assert all(r["kept"] for r in found)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        agreed = []
        for _ in range(60):
            items = rng.integers(0, 2**63, 400).astype(np.uint64)
            n = int(400 * (1 - share) / (1 + share))
            other = np.concatenate([items[n:], rng.integers(0, 2**63, n).astype(np.uint64)])
            agreed.append((minmax.signature(items) == minmax.signature(other)).mean())
        assert abs(np.mean(agreed) - share) < 0.02


def test_one_of_each_group_stays(spark):
    rows = copies(11)
    rows += rows[:5] + [(None, "no id at all in this one"), (None, "no id at all in this one"), (None, rows[0][1])]
    docs = documents(spark, rows)
    left = minmax.keep_first(docs, 3, 85)
    assert left.columns == docs.columns
    want = {c for _, c in by_hand(rows[:-3], 3, 85).values()}
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted(want)
    assert [r["text"] for r in left.where("doc_id is null").collect()] == ["no id at all in this one"]


def test_odd_rows(spark):
    rows = odd_rows()
    found = minmax.find(documents(spark, rows)).collect()
    assert sorted(r["n_shingles"] for r in found) == sorted(len(set_of(r[1], 5)) for r in rows)
    of = {(r["doc_id"], r["n_shingles"]): r for r in found}
    assert of[(2, len(set_of(rows[0][1], 5)))]["component_id"] == 1
    assert of[(3, 0)]["component_id"] == 3
    left = minmax.keep_first(documents(spark, rows))
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_no_rows(spark):
    assert minmax.find(documents(spark, [])).count() == 0
    assert minmax.keep_first(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (500, 500)]
    groups = Groups({n for e in edges for n in e})
    for a, b in edges:
        groups.join(a, b)
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: groups.top(n) for n in groups.up if groups.top(n) != n}

"""Links and components of near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from tertulia.llm import pivots, queries

SCHEMA = "vec_id long, embedding array<float>, label int, class string, node long, vec string, n int, pivots string"
NAMES = ["vec_id", "n_links", "component_id", "kept"]


def build(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], lab, "", 0, "", 0, "") for i, v, lab in rows], SCHEMA)


def usable(v, label):
    return v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, least=0.98):
    n = len(rows)
    linked = [[] for _ in range(n)]
    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if usable(v, label):
            groups.setdefault((label, len(v)), []).append(k)
    for held in groups.values():
        x = np.array([np.float32(rows[k][1]) for k in held]).astype(float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        near = x @ x.T >= least
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                linked[held[a]].append(held[b])
    root = [-1] * n
    for k in range(n):
        if root[k] < 0:
            todo = [k]
            root[k] = k
            while todo:
                for m in linked[todo.pop()]:
                    if root[m] < 0:
                        root[m] = k
                        todo.append(m)
    lowest = {}
    for k, (i, _, _) in enumerate(rows):
        known = lowest.get(root[k])
        lowest[root[k]] = i if known is None else known if i is None else min(known, i)
    return sorted(((i, len(linked[k]), lowest[root[k]], i == lowest[root[k]]) for k, (i, _, _) in enumerate(rows)), key=repr)


def found(spark, rows, least=0.98):
    return sorted((tuple(r[c] for c in NAMES) for r in pivots.find(build(spark, rows), least).collect()), key=repr)


def clustered(seed, dims, groups, size, noise):
    draw = np.random.default_rng(seed)
    out, number = [], 0
    for g in range(groups):
        base = draw.normal(size=dims)
        for _ in range(size if g else 4 * size):
            v = base + noise * draw.normal(size=dims) * np.linalg.norm(base) / np.sqrt(dims)
            out.append((number, (v * draw.uniform(0.5, 3)).tolist(), g % 3))
            number += 1
    return out


@pytest.mark.parametrize("dims,noise", [(64, 0.1), (64, 0.15), (16, 0.12), (256, 0.13), (3, 0.05)])
def test_clusters(spark, dims, noise):
    """Groups whose members are near 0.98 of each other, one four times as large, and single vectors."""
    draw = np.random.default_rng(5)
    rows = clustered(dims, dims, 40, 12, noise) + [(9000 + i, draw.normal(size=dims).tolist(), i % 4) for i in range(300)]
    got, want = found(spark, rows), plain(rows)
    links, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all_links > 500 and all_links * 0.995 <= links <= all_links
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.03 * len(rows)
    assert {r[0]: r[1] for r in got}.keys() == {r[0]: r[1] for r in want}.keys()


def test_crowded_lists_are_cut(spark, monkeypatch):
    """Blocks of a list meet each other, and no pair counts twice."""
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rows = clustered(3, 32, 3, 60, 0.1)
    assert found(spark, rows) == plain(rows)


def test_one_dense_group(spark):
    """A third of all rows as near copies of one vector: the pivots may not all lie among them."""
    rows = clustered(4, 64, 1, 150, 0.1) + [(5000 + i, v, 0) for i, (_, v, _) in enumerate(clustered(6, 64, 300, 1, 0.1))]
    assert found(spark, rows) == plain(rows)


def odd():
    v = [1.0, 2.0, 3.0]
    return [
        (1, v, 0), (1, v, 0), (2, v, 0), (3, v, 1), (4, [2.0, 4.0, 6.0], 0), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0),
        (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0), (10, [1.0, float("inf"), 3.0], 0), (11, [1.0, 2.0], 0),
        (12, [2.0, 4.0], 0), (13, [], 0), (None, v, 1), (None, [5.0, -1.0, 0.0], 2), (None, [5.0, -1.0, 0.0], 2),
        (14, [1.0, 2.0, 3.1], 0), (15, [-1.0, -2.0, -3.0], 0), (16, [1e30, 2e30, 3e30], 0), (17, [0.0, -0.0, 1.0], 2), (18, [-0.0, 0.0, 1.0], 2),
    ]


def test_odd_rows(spark):
    assert found(spark, odd()) == plain(odd())


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 0)]) == [(1, 0, 1, True)]


def test_long_chains_are_one_component(spark):
    """Neighbours are linked, the ends are far apart."""
    rows = [(i, [np.cos(i / 10), np.sin(i / 10), 0.0], 7) for i in range(25)]
    got = found(spark, rows)
    assert got == plain(rows) and {r[2] for r in got} == {0}


def test_query(spark):
    """check_s has groups of near copies; every link is found there."""
    sf = "/root/testdata/check_s"
    got = sorted((tuple(r[c] for c in NAMES) for r in queries.op11_pivots(spark, sf).collect()), key=repr)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want = plain([(r[0], r[1], r[2]) for r in rows])
    links, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.999 * all_links <= links <= all_links and all_links > 10_000

import heapq
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tertulia.llm import multiindex

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, ids int, part string, cell string, asked int, twin int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, 0, None, None, 0, 0) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def by_hand(rows, k, is_query):
    rows = [(i, np.array(v, "float32").astype(float)) for i, v in rows if i is not None and usable(v)]
    lengths = [len(v) for _, v in rows]
    rows = [(i, v) for i, v in rows if len(v) == max(set(lengths), key=lambda n: (lengths.count(n), n))]
    out = {}
    for q, a in rows:
        if is_query(q):
            scored = {(round(-(a @ b) / math.sqrt(a @ a) / math.sqrt(b @ b), 12), i) for i, b in rows if i != q}
            out[q] = [(i, -s) for s, i in heapq.nsmallest(k, scored)]
    return out


def check(found, want, exact=True):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {q for q, hits in want.items() if hits}
    hits = 0
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, len(want[q]) + 1))
        scores = [ranked[i][1] for i in sorted(ranked)]
        assert scores == sorted(scores, reverse=True)
        for (a, s), (b, t) in zip((ranked[i] for i in sorted(ranked)), want[q], strict=True):
            if exact:
                assert a == b
                assert math.isclose(s, t, abs_tol=1e-9)
        hits += len({v for v, _ in ranked.values()} & {v for v, _ in want[q]})
    return hits / max(1, sum(len(hits) for hits in want.values()))


def random_rows(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=d).astype("float32").tolist()) for i in range(n)]


def test_heap_walks_pairs_in_order():
    rng = random.Random(2)
    for a, b in ((1, 1), (1, 5), (7, 3), (20, 20)):
        x, y = np.array([rng.random() for _ in range(a)]), np.array([rng.random() for _ in range(b)])
        walked = list(multiindex.nearest_pairs(x, y))
        assert len(set(walked)) == len(walked) == a * b
        sums = [x[i] + y[j] for i, j in walked]
        assert sums == sorted(sums)


def test_all_cells_give_the_exact_answer(spark):
    """With few vectors every cell is looked into."""
    rows = random_rows(400)
    found = multiindex.search(vectors(spark, rows).repartition(3), F.col("vec_id") % 5 == 0).collect()
    check(found, by_hand(rows, 5, lambda i: i % 5 == 0))


def test_recall(spark, monkeypatch):
    rows = random_rows(6000)
    found = multiindex.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, centroids=64).collect()
    assert check(found, by_hand(rows, 5, lambda i: i % 50 == 0), exact=False) >= 0.9


def test_clustered_recall_with_a_small_share(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    rows = [(i, (centres[i % 300] + 0.05 * rng.normal(size=16)).astype("float32").tolist()) for i in range(6000)]
    found = multiindex.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, share=0.05).collect()
    assert check(found, by_hand(rows, 5, lambda i: i % 50 == 0), exact=False) >= 0.9


def test_many_equal_vectors(spark):
    rows = random_rows(60)
    rows += [(100 + i, rows[0][1]) for i in range(500)] + [(700 + i, (2 * np.array(rows[1][1])).tolist()) for i in range(20)]
    found = multiindex.search(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    check(found, by_hand(rows, 5, lambda i: i % 10 == 0))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (10, [0.0, 0.0]), (20, None), (30, [1.0, None]), (40, [nan, 1.0]), (50, [inf, 1.0]),
        (60, []), (70, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [-1.0, 0.0]), (80, [1e-30, 1e-30]), (90, [3e38, -3e38]),
    ]
    found = multiindex.search(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == {
        (0, 1): 5, (0, 2): 80, (0, 3): 90, (0, 4): 6,
        (80, 1): 5, (80, 2): 0, (80, 3): 90, (80, 4): 6,
        (90, 1): 0, (90, 2): 5, (90, 3): 80, (90, 4): 6,
    }


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(3, [1.0, 2.0]), (4, [1.0, 2.0])]])
def test_nothing_to_find(spark, rows):
    assert multiindex.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).count() == 0


def test_single_component(spark):
    found = multiindex.search(vectors(spark, [(0, [2.0]), (1, [-1.0]), (2, [5.0])]), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 1.0), (1, -1.0)]


def test_blocks_never_go_through_the_driver(spark):
    """However large a table Spark may broadcast, and however small it takes the routed queries for."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        rows = random_rows(400)
        found = multiindex.search(vectors(spark, rows).repartition(3), F.col("vec_id") % 5 == 0)
        check(found.collect(), by_hand(rows, 5, lambda i: i % 5 == 0))
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(\w+Join)\b.*\[(\w+)#\d+\], \[\2#\d+\]", plan.partition("Initial Plan")[0])
        assert {join for join, key in joins if key != "twin"} == {"SortMergeJoin"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("share", [0.02, 0.4, 1.0])
def test_best_of_many_blocks(monkeypatch, share):
    """Whatever blocks the entries come in, with ties between entries that are multiples of each other."""
    monkeypatch.setattr(multiindex, "PAIRS", 7)
    rng = np.random.default_rng(4)
    asked, vectors = rng.normal(size=(30, 6)), rng.normal(size=(400, 6))
    vectors[200:230] = 2 * vectors[0]
    cells, open_cells = rng.integers(0, 16, 400), rng.random((30, 16)) < share
    exact = multiindex.unit_rows(asked) @ multiindex.unit_rows(vectors).T
    want = {
        q: sorted((round(-exact[q, e], 12), 1000 - e) for e in range(400) if open_cells[q, cells[e]])[:5] for q in range(30) if open_cells[q].any()
    }

    def lists(rows):
        return pa.array(rows.tolist(), pa.list_(pa.float64()))

    masks = pa.array([np.packbits(m).tobytes() for m in open_cells], pa.binary())
    queries = pa.StructArray.from_arrays([pa.array(range(30)), lists(asked), masks], names=["vec_id", "vec", "cells"])
    for size in (1, 3, 4, 50, 400):
        ranking = multiindex.Ranking(queries, 5)
        for at in range(0, 400, size):
            e = np.arange(at, min(at + size, 400))
            columns = [pa.array([[1000 - int(i)] for i in e]), lists(vectors[e]), pa.array(cells[e], pa.int32())]
            ranking.meet(pa.StructArray.from_arrays(columns, names=["ids", "vec", "cell"]))
        got = {}
        for r in ranking.found().to_pylist():
            got.setdefault(r["twin"], []).append((round(-r["score"], 12), r["ids"][0]))
        assert {q: sorted(found) for q, found in got.items()} == {q: found for q, found in want.items() if found}


def test_small_blocks_and_groups(spark, monkeypatch):
    rows = random_rows(500)
    for name, value in (("ENTRIES", 7), ("QUERIES", 9), ("ROUTED", 5), ("GROUPS", 3)):
        monkeypatch.setattr(multiindex, name, value)
    found = multiindex.search(vectors(spark, rows).repartition(3), F.col("vec_id") % 5 == 0).collect()
    check(found, by_hand(rows, 5, lambda i: i % 5 == 0))

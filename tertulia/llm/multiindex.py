"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to unit length and cut into halves, and each half is quantised with a codebook of
its own. A pair of centroids names a cell. For a query, a heap walks the pairs of centroids in the order
of their summed distance until the cells it has passed hold the wanted share of all vectors; the vectors
in these cells are ranked by their exact cosine.

Only the codebooks come from a sample. Every vector is indexed, equal ones once with their smallest ids.
Vectors and queries meet by groups of the first half's centroids, in blocks of bounded size, so a centroid
that has most of the vectors is many rows, and the pairs within two blocks never become rows. A query
travels once for each group it looks into.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.plans.staging import discard, settle, stage

ENTRIES, QUERIES = 2048, 1024  # vectors in a block
ROUTED = 64  # queries that a task routes
GROUPS = 64  # of the first half's centroids: the cells of a group meet their queries in one place
PAIRS = 65_536  # of which exact cosines are taken at a time


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the first and of the second half of unit vectors."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(unit[:, : self.cut], self.first), _squared(unit[:, self.cut :], self.second)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    # Dividing by the largest component first keeps squares of huge or tiny ones in range.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    picked = np.random.default_rng(seed).choice(len(x), k, replace=False)
    centroids = x[picked].copy()
    for _ in range(rounds):
        nearest = _squared(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)[:, None]
        centroids = np.where(counts > 0, sums / np.maximum(counts, 1), centroids)
    return centroids


def nearest_pairs(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by summed distance, nearest first.

    With both lists in order, a pair can come next only once its neighbours below in each list have.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, reached = [(x[0] + y[0], 0, 0)], [0] * len(x)  # reached: how far each row has been walked
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        reached[i] = j + 1
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))


def cells_for(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, needed: int) -> np.ndarray:
    """Which cells a query looks into: the nearest pairs that together hold `needed` vectors."""
    open_cells = np.zeros(sizes.shape, bool)
    found = 0
    for i, j in nearest_pairs(first, second):
        if sizes[i, j]:
            open_cells[i, j] = True
            found += int(sizes[i, j])
            if found >= needed:
                break
    return open_cells


def usable(vec: Column) -> Column:
    """Vectors that have a direction: not null, not zero, all components present and finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def fit(entries: DataFrame, total: int, centroids: int, sample: int) -> Codebooks | None:
    """Codebooks from at most about `sample` vectors, picked by a hash of their id."""
    share = min(1.0, sample / max(total, 1))
    limit = int(share * 2**20)
    picked = entries.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(2**20)) < limit).select("vec") if share < 1 else entries.select("vec")
    rows = picked.limit(2 * sample).toArrow().column("vec").combine_chunks()
    if len(rows) == 0:
        return None
    unit = unit_rows(matrix(rows))
    cut = max(1, unit.shape[1] // 2)
    k = max(1, min(centroids, len(unit) // 8))
    second = unit[:, cut:] if unit.shape[1] > cut else np.zeros((len(unit), 1))
    return Codebooks(k_means(unit[:, :cut], k), k_means(second, k) if unit.shape[1] > cut else np.zeros((1, 0)))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vec: str = "embedding",
    centroids: int = 128,
    sample: int = 20_000,
    share: float = 0.45,
) -> DataFrame:
    """The `k` vectors nearest to each query by cosine: query_id, rank, vec_id and score.

    Queries are the rows that `is_query` holds for; candidates are all rows but those of the query's
    own id; ties go to the smaller id. Vectors without a direction, without an id, or of another
    length than most take no part, neither as queries nor as candidates. Equal vectors are found by
    their ids, repeated rows of one id once. If there are fewer candidates than `k`, all are given.

    `share` is the share of distinct vectors that a query's cells must hold. Vectors without any
    structure need a large one for a recall of 0.9; in clustered data a few hundredths do.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("vec"), is_query.alias("asked"))
    valid = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).withColumn("length", F.size("vec"))
    lengths = valid.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max_by("length", F.struct("n", "length"))).scalar()
    taking = valid.where(F.col("length") == usual)

    smallest = Window.partitionBy("vec").orderBy("vec_id")
    first_ids = taking.select("vec", "vec_id").withColumn("nth", F.dense_rank().over(smallest)).where(F.col("nth") <= k + 1)
    entries = stage(first_ids.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    asked = taking.where("asked").select("vec", "vec_id").distinct()
    # The entries are written by now, so this also lets their shuffle files go.
    queries = settle(asked.withColumn("twin", F.min("vec_id").over(Window.partitionBy("vec"))))
    searched = queries.where("vec_id = twin").select("vec_id", "vec")

    total, n_queries = entries.count(), searched.count()
    books = fit(entries, total, centroids, sample)
    if books is None:
        return queries.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), F.col("vec_id"), F.lit(0.0).alias("score")
        ).where(F.lit(False))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = books.distances(unit_rows(matrix(batch.column("vec")))) if len(batch) else (np.zeros((0, 1)),) * 2
            cells = [pa.array(d.argmin(1).astype("int32"), pa.int32()) for d in (d1, d2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=["vec", "ids", "part", "cell"])

    kind = entries.schema["vec"].dataType.simpleString()
    placed = stage(entries.select("vec", "ids").mapInArrow(assign, f"vec {kind}, ids array<long>, part int, cell int"))
    sizes = np.zeros((len(books.first), len(books.second)), "int64")
    for r in placed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most centroids**2
        sizes[r["part"], r["cell"]] = r["n"]
    needed = max(int(np.ceil(share * total)), 100 * k)
    discard(entries)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d1, d2 = books.distances(unit_rows(matrix(batch.column("vec"))))
            masks = [np.packbits(cells_for(d1[row], d2[row], sizes, needed), axis=1).tobytes() for row in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.binary())], names=["vec_id", "vec", "cells"])

    # The staged queries are one small file or few, and routing them is dear.
    dealt = searched.repartition(max(1, -(-n_queries // ROUTED)), "vec_id")
    routed = dealt.mapInArrow(route, f"vec_id long, vec {kind}, cells binary")
    in_blocks = (
        routed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n_queries // QUERIES)))).cast("int"))
        .groupBy("block")
        .agg(F.collect_list(F.struct("vec_id", "vec", "cells")).alias("queries"))
    )
    groups = min(GROUPS, len(sizes))
    width = -(-sizes.shape[1] // 8)  # bytes of a centroid's cells in a mask

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in zip(batch.column("block").to_pylist(), batch.column("queries"), strict=True):
                masks = unpacked(row.values.field("cells")).reshape(len(row.values), len(sizes), width)
                for group in range(groups):
                    yield from _asking(group, block, row.values, masks[:, group::groups])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.StructArray]] = {group: [] for group in range(groups)}
        for batch in batches:
            part, cell = (batch.column(c).to_numpy() for c in ("part", "cell"))
            place = pa.array(part // groups * (8 * width) + cell, pa.int32())
            rows = pa.StructArray.from_arrays([batch.column("ids"), batch.column("vec"), place], names=["ids", "vec", "cell"])
            for group in np.unique(part % groups).tolist():
                mine = np.flatnonzero(part % groups == group)
                for at in range(0, len(mine), ENTRIES):
                    held[group].append(rows.take(pa.array(mine[at : at + ENTRIES])))
                    if sum(map(len, held[group])) >= ENTRIES:
                        yield _one_row(pa.concat_arrays(held.pop(group)), "entries", group=group)
                        held[group] = []
        for group, left in held.items():
            if left:
                yield _one_row(pa.concat_arrays(left), "entries", group=group)

    query_blocks = in_blocks.mapInArrow(
        deal, f"group int, block int, queries array<struct<vec_id: bigint, vec: {kind}, cells: binary>>"
    )
    entry_blocks = placed.mapInArrow(pack, f"group int, entries array<struct<ids: array<bigint>, vec: {kind}, cell: int>>")
    # Spark takes a block for one vector, and a query for one row where it is one for each group it looks
    # into: it would send all of them through the driver to every executor.
    met = query_blocks.join(entry_blocks.hint("merge"), "group").select("group", "block", "queries", "entries")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking, of = None, None
        for batch in batches:
            for row in range(len(batch)):
                if of != (now := (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())):
                    if ranking:
                        yield ranking.found()
                    ranking, of = Ranking(batch.column(2)[row].values, k + 1), now
                ranking.meet(batch.column(3)[row].values)
        if ranking:
            yield ranking.found()

    found = met.mapInArrow(rank, "twin long, ids array<long>, score double")
    by_score = Window.partitionBy("twin").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    each = F.struct((-F.col("score")).alias("minus"), F.col("ids"))
    lists = best.groupBy("twin").agg(F.collect_list(each).alias("classes"))
    named = F.flatten(F.transform("classes", lambda c: F.transform(c["ids"], lambda i: F.struct(c["minus"].alias("minus"), i.alias("id")))))
    others = F.filter(F.array_sort(named), lambda c: c["id"] != F.col("vec_id"))
    answered = queries.select("vec_id", "twin").join(lists, "twin").withColumn("hits", F.slice(others, 1, k))
    return answered.select(F.col("vec_id").alias("query_id"), F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )


def unpacked(masks: pa.Array) -> np.ndarray:
    """Bytes of equal lengths as rows."""
    return np.frombuffer(b"".join(masks.to_pylist()), "uint8").reshape(len(masks), -1)


def _one_row(values: pa.StructArray, name: str, **columns: int) -> pa.RecordBatch:
    """A row that holds `values` as a list."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([*(pa.array([c], pa.int32()) for c in columns.values()), whole], names=[*columns, name])


def _asking(group: int, block: int, queries: pa.StructArray, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The queries of a block that look into a group, with what they look into there."""
    asking = np.flatnonzero(masks.any((1, 2)))
    if len(asking):
        cells = pa.array([masks[q].tobytes() for q in asking], pa.binary())
        vec_id, vec = (queries.field(c).take(pa.array(asking)) for c in ("vec_id", "vec"))
        yield _one_row(pa.StructArray.from_arrays([vec_id, vec, cells], names=["vec_id", "vec", "cells"]), "queries", group=group, block=block)


class Ranking:
    """The `k` best entries for each query of a block, among the cells the query looks into, of all blocks it meets."""

    def __init__(self, queries: pa.StructArray, k: int) -> None:
        self.k = k
        self.twins = queries.field("vec_id").to_numpy()
        self.units = unit_rows(matrix(queries.field("vec")))
        self.open = np.unpackbits(unpacked(queries.field("cells")), axis=1).astype(bool)
        self.least = np.full(len(self.twins), -np.inf)  # cosine of the k-th so far
        self.rows, self.scores, self.first_ids = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
        self.ids: pa.ListArray | None = None

    def meet(self, entries: pa.StructArray) -> None:
        cells, ids = entries.field("cell").to_numpy(), entries.field("ids")
        asking = np.flatnonzero(self.open[:, np.unique(cells)].any(1))
        units = unit_rows(matrix(entries.field("vec")))
        near, edge = self.units[asking] @ units.T, self.least[asking]
        new = np.flatnonzero(edge == -np.inf)
        if len(new):
            near[new] = np.where(self.open[asking[new]][:, cells], near[new], -np.inf)
            if len(cells) > self.k:
                edge[new] = np.partition(near[new], -self.k, axis=1)[:, -self.k]
        # A product of matrices may round ties apart: what is as good as equal stays in.
        rows, cols = np.nonzero(near >= np.maximum(edge - 1e-9, -2.0)[:, None])
        looked = self.open[asking[rows], cells[cols]]
        rows, cols = asking[rows[looked]], cols[looked]
        pairs = [slice(at, at + PAIRS) for at in range(0, len(rows), PAIRS)]
        scores = [cosines(self.units[rows[p]], units[cols[p]]) for p in pairs]
        self._add(rows, np.concatenate([np.zeros(0), *scores]), ids.take(pa.array(cols)))

    def _add(self, rows: np.ndarray, scores: np.ndarray, ids: pa.ListArray) -> None:
        if self.ids is not None and not len(rows):
            return
        rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        first_ids = np.concatenate([self.first_ids, pc.list_element(ids, 0).to_numpy(zero_copy_only=False).astype("int64")])
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        order = np.lexsort((first_ids, -scores, rows))
        nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        last = order[nth == self.k - 1]
        self.least[rows[last]] = scores[last]
        kept = order[nth < self.k]
        self.rows, self.scores, self.first_ids, self.ids = rows[kept], scores[kept], first_ids[kept], ids.take(pa.array(kept))

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.twins[self.rows]), self.ids, pa.array(self.scores)], names=["twin", "ids", "score"])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` and the row of `b` beside it, of unit length both, summed in the same way wherever a pair meets."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return np.clip(total, -1.0, 1.0)

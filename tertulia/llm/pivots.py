"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by the reference points (pivots) nearest to it, in order. Vectors of a small angle
order the pivots nearly alike, so they share most of their first eight. The index has a list for every two
pivots, of the vectors that have both among their first: who meets in a list shares two pivots at least.
A pair may meet in several lists; it is verified in the first of them alone, which the pivots that both
share tell. Verification is exact, in double precision.

Equal vectors of a label are one entry, so a crowd of copies is one. Lists that hold one entry are dropped
before any vector moves, and long ones are cut into blocks that meet each other. The pairs within a list never become
rows: a task gives each entry's number of links and the edges of a forest that connects what is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.llm.graph import components
from tertulia.llm.multiindex import matrix, unit_rows, usable
from tertulia.plans.staging import stage

PIVOTS, FIRST = 1024, 8  # pivots at most, and how many of them describe a vector
APART = 0.9  # the largest cosine of two pivots: 25 degrees, over twice the angle of vectors to be linked
SAMPLE, SAMPLE_VALUES = 8192, 4_000_000  # vectors pivots are chosen from: at most so many, and so many components
BLOCK = 1024  # entries in a block of a list
SHORT = 64  # entries in a list whose pairs are laid out one by one
PAIRS = 32_768  # pairs compared at once
EDGE = 1e-9  # cosines this near to the bound are computed once more, with exact sums


def choose_pivots(unit: np.ndarray, dims: int) -> np.ndarray:
    """Reference points far from each other: each next one is the sampled vector farthest from those
    chosen, as long as it is APART from all. Then random directions fill up under the same condition; few
    dimensions have room for few."""
    draw = np.random.default_rng(dims)
    chosen = np.zeros((0, dims))
    for source in (unit, unit_rows(draw.normal(size=(2 * PIVOTS, dims)))):
        if not len(source):
            continue
        nearest = (source @ chosen.T).max(1, initial=-1.0)
        while len(chosen) < PIVOTS and nearest.min() < APART:
            chosen = np.vstack([chosen, source[nearest.argmin()]])
            nearest = np.maximum(nearest, source @ chosen[-1])
    return chosen


def fit(entries: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by the number of dimensions, from a sample of at most SAMPLE vectors of each of the eight most
    frequent numbers. Vectors of other lengths are described by random directions."""
    pivots = {}
    lengths = entries.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    for r in lengths.orderBy(F.desc("n"), "dims").limit(8).collect():
        wanted = min(SAMPLE, max(1, SAMPLE_VALUES // r["dims"]))
        share = int(min(1.0, 1.2 * wanted / r["n"]) * 2**20)
        same = entries.where((F.size("vec") == r["dims"]) & (F.pmod(F.xxhash64("class"), F.lit(2**20)) < share))
        sample = same.select("class", "vec").limit(2 * wanted).toArrow().combine_chunks()
        order = np.argsort(np.array(sample.column("class").to_pylist(), dtype=object), kind="stable")[:wanted]
        vectors = sample.column("vec").combine_chunks().take(pa.array(order))
        pivots[r["dims"]] = choose_pivots(unit_rows(matrix(vectors)) if len(order) else np.zeros((0, r["dims"])), r["dims"])
    return pivots


def first_pivots(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the FIRST nearest pivots of each row, nearest first. Where there are fewer, all rows
    have the numbers that are missing too, and so meet."""
    near = np.hstack([unit @ pivots.T, np.tile(-np.arange(2.0, 2 + max(0, FIRST - len(pivots))), (len(unit), 1))])
    some = np.argpartition(-near, FIRST - 1, axis=1)[:, :FIRST]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int16)


def classes(vectors: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """vec_id, class (of equal vectors of one label, null for what takes no part), label and vec."""
    able = F.col(label).isNotNull() & usable(F.col(vec))
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.when(able, F.col(label).cast("string")).alias("label"), F.when(able, F.col(vec)).alias("vec")
    )
    schema = f"vec_id long, label string, vec {rows.schema['vec'].dataType.simpleString()}, class binary"

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, column = batch.column(1), batch.column(2)
            values = column.values.to_numpy(zero_copy_only=False).astype(float) + 0.0  # no zero has a sign
            ends = column.offsets.to_numpy()
            names = [
                xxhash.xxh3_128_digest(values[a:b].tobytes(), seed=xxhash.xxh32_intdigest(labels[i].as_py())) if labels[i].is_valid else None
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], names=["vec_id", "label", "vec", "class"])

    return rows.mapInArrow(of_batch, schema)


def described(entries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """`entries` with the numbers of their first pivots."""
    kind = entries.schema["vec"].dataType.simpleString()

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(pivots)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vec"))
            sizes = np.diff(column.offsets.to_numpy())
            firsts = np.zeros((len(batch), FIRST), np.int16)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                if dims not in known:
                    known[dims] = choose_pivots(np.zeros((0, dims)), dims)
                firsts[rows] = first_pivots(unit_rows(matrix(column.take(pa.array(rows)))), known[dims])
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * FIRST, pa.array(firsts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "pivots"])

    return entries.mapInArrow(of_batch, f"node long, class binary, label string, vec {kind}, n long, pivots array<short>")


def links(nodes: DataFrame, least: float) -> DataFrame:
    """For each list and each entry with a link in it: node, the root it hangs on there, and the number of
    vectors it is linked with. Every pair counts in one list alone."""
    pair = F.struct(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    pairs = F.flatten(
        F.transform("pivots", lambda x, i: F.transform(F.slice("pivots", i + 2, FIRST), lambda y: F.struct(x.alias("p"), y.alias("q"))))
    )
    key = ["label", "dims", "p", "q"]
    each = nodes.select("label", F.size("vec").alias("dims"), "node", F.explode(pairs).alias("pair")).select("label", "dims", "node", "pair.*")
    each = each.select("label", "dims", "node", pair.alias("pair")).select("label", "dims", "node", "pair.*")
    lists = each.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    blocks = lists.select(*key, F.ceil(F.col("held") / BLOCK).alias("blocks"))
    placed = stage(each.join(stage(blocks), key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    member = F.struct("node", "n", "vec", "pivots")
    held = placed.join(nodes.select("node", "n", "vec", "pivots"), "node").groupBy(*key, "block", "blocks").agg(F.collect_list(member).alias("members"))
    cut = stage(held.where("blocks > 1"))
    one = cut.select(*key, F.col("block").alias("first"), F.col("members").alias("left"))
    two = cut.select(*key, F.col("block").alias("second"), F.col("members").alias("right"))
    across = one.join(two, key).where("first < second").select("p", "q", "left", "right")
    within = held.select("p", "q", F.col("members").alias("left"), F.expr("cast(null as array<struct<node:bigint>>)").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from linked_in(batch, least)

    shape = "node long, root long, links long"
    return within.select("p", "q", "left").mapInArrow(compare, shape).unionByName(across.mapInArrow(compare, shape))


def _bits() -> tuple[np.ndarray, np.ndarray]:
    """For each pivot, its own bit and the bits of all before it, in words of 64."""
    own = np.zeros((PIVOTS, PIVOTS // 64), np.uint64)
    own[np.arange(PIVOTS), np.arange(PIVOTS) // 64] = np.uint64(1) << (np.arange(PIVOTS) % 64).astype(np.uint64)
    return own, np.cumsum(own, axis=0, dtype=np.uint64) - own


class Members:
    """The entries of several lists or blocks as arrays, one after another."""

    def __init__(self, column: pa.Array):
        structs = column.values
        self.ends = column.offsets.to_numpy()
        self.sizes = np.diff(self.ends)
        self.node, self.n = (structs.field(f).to_numpy() for f in ("node", "n"))
        self.vecs = structs.field("vec")
        self.bits = np.zeros((len(structs), PIVOTS // 64), np.uint64)
        pivots = structs.field("pivots").flatten().to_numpy().reshape(-1, FIRST).astype(np.int64)
        for k in range(FIRST):  # the pivots of an entry differ, so no bit is met twice
            self.bits[np.arange(len(pivots)), pivots[:, k] // 64] |= np.uint64(1) << (pivots[:, k] % 64).astype(np.uint64)

    def units(self, rows: np.ndarray) -> np.ndarray:
        return unit_rows(matrix(self.vecs.take(pa.array(rows))))


def linked_in(batch: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """Links within each list of a batch, or between its two blocks where it has two.

    The pairs of short lists are laid out side by side, those of long ones are products of matrices. A pair
    belongs to a list (p, q) if the two share no pivot before q but p.
    """
    own, before = _bits()
    ps, qs = (batch.column(k).to_numpy() for k in (0, 1))
    masks = before[qs] & ~own[ps]
    left = Members(batch.column(2))
    if batch.num_columns == 4:
        right, short = Members(batch.column(3)), np.zeros(len(batch), bool)
    else:
        right, short = left, left.sizes <= SHORT
    for row in np.flatnonzero(~short):
        a = np.arange(left.ends[row], left.ends[row + 1])
        b = np.arange(right.ends[row], right.ends[row + 1])
        ua, ub = left.units(a), right.units(b)
        masked = right.bits[b] & masks[row]
        step = max(1, PAIRS * 8 // max(1, len(b)))
        found_a, found_b = [], []
        for start in range(0, len(a), step):
            some = slice(start, start + step)
            near = ua[some] @ ub.T >= least - EDGE
            if right is left:
                near &= a[some, None] < b[None, :]
            x, y = np.nonzero(near)
            mine = ~(left.bits[a[some]][x] & masked[y]).any(1)
            found_a.append(x[mine] + start)
            found_b.append(y[mine])
        x, y = np.concatenate(found_a), np.concatenate(found_b)
        sure = confirmed(ua, ub, x, y, least)
        if sure.any():
            yield forest(left, right, a[x[sure]], b[y[sure]])
    if short.any():
        x, y = short_pairs(left, masks, short)
        found = []
        dims = np.diff(left.vecs.offsets.to_numpy())[x]
        for d in np.unique(dims):
            for some in np.array_split(np.flatnonzero(dims == d), -(-int((dims == d).sum()) // PAIRS)):
                ux, uy = left.units(x[some]), left.units(y[some])
                at = np.arange(len(some))
                found.append(some[confirmed(ux, uy, at, at, least)])
        if found:
            sure = np.concatenate(found)
            if len(sure):
                yield forest(left, left, x[sure], y[sure])


def short_pairs(members: Members, masks: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within each short list that belong to it."""
    owner = np.repeat(np.arange(len(members.sizes)), members.sizes)
    rows = np.flatnonzero(short[owner])
    found_x, found_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    later = members.ends[owner[rows] + 1] - rows - 1
    for some in np.array_split(np.arange(len(rows)), max(1, -(-int(later.sum()) // (PAIRS * 8)))):
        n = later[some]
        x = np.repeat(rows[some], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        mine = ~(members.bits[x] & members.bits[y] & masks[owner[x]]).any(1)
        found_x.append(x[mine])
        found_y.append(y[mine])
    return np.concatenate(found_x), np.concatenate(found_y)


def confirmed(ua: np.ndarray, ub: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs reach the bound; those at its edge by sums without rounding."""
    sure = np.zeros(len(x), bool)
    for start in range(0, len(x), PAIRS):
        some = slice(start, start + PAIRS)
        near = np.einsum("ij,ij->i", ua[x[some]], ub[y[some]])
        sure[some] = near >= least
        for k in np.flatnonzero(np.abs(near - least) <= EDGE):
            u, v = ua[x[some][k]], ub[y[some][k]]
            sure[start + k] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v)) >= least
    return sure


def forest(left: Members, right: Members, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Links as rows for each entry: how many vectors it is linked with, and a root all that hang together share."""
    nodes = np.concatenate([left.node[x], right.node[y]])
    counts = np.concatenate([right.n[y], left.n[x]])
    names, at = np.unique(nodes, return_inverse=True)
    links_of = np.bincount(at, weights=counts).astype(np.int64)
    u, v = at[: len(x)], at[len(x) :]
    root = np.arange(len(names))
    while True:  # the smaller root goes to both ends of every link, then roots to their own roots
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root != root[root]).any():
        root = root[root]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root]), pa.array(links_of)], names=["node", "root", "links"])


def find(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each row of `vectors`: vec_id, n_links, component_id and kept.

    Rows of one label are linked when the cosine of their vectors is `least` or more; n_links counts the
    other rows a row is linked with. A component is what links connect, named by its smallest id, and
    kept is the row of that id.

    Rows without a label, and vectors that are missing, zero, or hold missing or non-finite components
    are linked with nothing. So are vectors of different lengths with one another. Equal vectors of a label are
    linked, repeated rows of one id too, each being a row of its own. A component without any id
    has none; rows without id take part and are kept only in such a component. No rows give no rows;
    other columns are ignored.

    Pivots come from a bounded sample (see `fit`); every vector is indexed. A pair is found when it shares
    two of its first eight pivots, which near pairs all but always do; see the README for the recall.
    """
    rows = stage(classes(vectors, key, vec, label))
    some = rows.where(F.col("class").isNotNull())
    grouped = some.groupBy("class").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lowest")
    )
    entries = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "class", "label", "vec", "n", "lowest"))
    nodes = stage(described(entries.select("node", "class", "label", "vec", "n"), fit(entries)))
    found = stage(links(nodes, least))
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))

    named = entries.select("node", "class", "lowest", "n")
    roots = joined.select("root").distinct().select(F.col("root").alias("node"), "root").unionByName(joined.select("node", "root"))
    of_root = roots.join(named, "node").groupBy("root").agg(F.min("lowest").alias("of_component"))
    reached = roots.join(of_root, "root").select("node", "of_component", F.lit(True).alias("linked"))
    figures = named.join(degrees, "node", "left").join(reached, "node", "left").select(
        "class",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("of_component")).otherwise(F.col("lowest")).alias("component_id"),
    )
    taking = some.select("vec_id", "class").join(stage(figures), "class").select("vec_id", "n_links", "component_id")
    apart = rows.where(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return taking.unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

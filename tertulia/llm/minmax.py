"""Near duplicates by min-max hashing.

A document is the set of its word shingles. Under each hash function both the smallest and the largest
value are kept, so 48 evaluations give a signature of 96 values: a pair of sets agrees on a smallest or
a largest value with a probability of its similarity. Signatures are banded, four values a band; sets
that share a band are candidates, and each link is confirmed on the full sets.

Documents with equal sets form a class, and from there on only classes are handled, so a crowd of copies
is one node. Of a bucket of near copies not all pairs are tried: every member is compared with the
bucket's centre, links are joined into components, and only where a bucket still has several components
are members of different ones compared with each other. A pair within a component could not change it.
Before that, what is found in one candidate's set only is counted: it bounds every intersection, so a
copy with too many changes of its own drops out without being compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.llm.columns import free_names
from tertulia.llm.graph import components
from tertulia.llm.words import lower_words
from tertulia.plans.staging import stage

BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band once in 300,000, one of 0.85 once in 50 million
HASHES = BANDS * ROWS // 2
SIEVE = 2**24
BLOCK_ITEMS = 200_000  # items of the sets in a block of members
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"seed%d" % i) for i in range(HASHES)], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered for as long as they are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, sorted. With fewer words than `width`, the
    whole sequence is the only shingle; without words there is none."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    width = min(width, len(ids))
    n = len(ids) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = scramble(mixed * _M3 + ids[k : k + n])
    return np.unique(mixed)


def signature(items: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under each hash function, side by side."""
    low, high = np.full(HASHES, 2**64 - 1, np.uint64), np.zeros(HASHES, np.uint64)
    for start in range(0, len(items), 4096):
        values = items[start : start + 4096][None, :] ^ _SEEDS[:, None]
        values = (values ^ (values >> np.uint64(31))) * _M1
        low = np.minimum(low, values.min(1))
        high = np.maximum(high, values.max(1))
    return np.stack([low, high], 1).reshape(-1)


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band, which holds the number of the band and its values."""
    parts = scramble(values).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = scramble(keys * _M3 + parts[:, r])
    return keys.view(np.int64)


def sketch(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, class (of equal sets; null for an empty one) and bands."""
    kinds = {
        "doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "class": pa.binary(),
        "bands": pa.list_(pa.int64()),
    }

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for value in batch.column(2):
                items = shingles(value.as_py(), width, hashes)
                if not len(items):
                    rows.append((0, None, None))
                    continue
                rows.append((len(items), xxhash.xxh3_128_digest(items.tobytes()), bands(signature(items))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            arrays = [pa.array(c, kind) for c, kind in zip(columns, list(kinds.values())[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=list(kinds))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return read.mapInArrow(of_batch, "doc_id long, text_hash long, n_shingles long, class binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, text: str = "text") -> DataFrame:
    """The set of each node in `wanted` (node, doc_id, text_hash), from one of its documents."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(value.as_py(), width, hashes).view(np.int64) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    same = F.col("hash").eqNullSafe(F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id"))
    found = sifted(read, ["id", "hash"], wanted, ["doc_id", "text_hash"]).join(wanted, same).select("node", "text")
    return found.mapInArrow(of_batch, "node long, items array<long>")


def sifted(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_keys: list[str]) -> DataFrame:
    """`rows` without most of those whose keys are not in `wanted`, so that a join moves little text.

    The keys set bits of a map of SIEVE bits, which goes to every task: 64 bits a row, 262,144 rows at
    most, whatever the size of `wanted`.
    """
    flagged = marked(rows, keys, wanted, wanted_keys, "hit")
    return flagged.where("hit").drop("hit")


def marked(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_keys: list[str], name: str) -> DataFrame:
    """`rows` with a flag that is false only where the keys are surely not in `wanted`."""
    word, place, bits = free_names(rows, ["word", "place", "bits"])
    places = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(SIEVE))
    table = (
        wanted.select(places(wanted_keys).alias(place))
        .groupBy(F.expr(f"{place} div 64").alias(word))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias(bits))
    )
    placed = rows.withColumn(place, places(keys)).withColumn(word, F.expr(f"{place} div 64"))
    hit = F.expr(f"shiftright({bits}, cast({place} % 64 as int)) & 1") == 1
    return placed.join(F.broadcast(table), word, "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, place, bits)


def own_counts(sets: DataFrame) -> DataFrame:
    """How many items of each node's set occur in no other node's set: node, own; nodes without any
    are left out. Only items found once are passed on."""
    single = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("node")
    ).where("n = 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    similar = 100 * both >= percent * (F.size("left") + F.size("right") - both)
    return pairs.join(second, "b").join(first, "a").where(similar).select("a", "b")


def possible(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar enough, by their sizes and by how much of them is shared at all.

    `a` and `b` are prefixes of the columns with these figures.
    """
    n, m = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    both = F.least(n, m, f"{a}shared", f"{b}shared")
    return 100 * both >= percent * (n + m - both)


def find(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_shingles, component_id and kept.

    Documents are linked when their sets have a Jaccard similarity of at least `percent` hundredths; a
    component is what links connect, named by its smallest doc_id, and the document of that id is
    kept. A missing text, or one without words, has an empty set, is linked with nothing and kept.
    Equal rows give equal rows. A component without any doc_id has none, and its rows are kept;
    elsewhere rows without doc_id are not. No rows give no rows; other columns are ignored. Long texts
    are read whole.

    `percent` should be 80 or more; the bands are laid out for that.
    """
    sketches = stage(sketch(docs, width))
    some = sketches.where("n_shingles > 0")
    one = F.struct("doc_id", "text_hash")
    grouped = some.groupBy("class").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), one)), F.min(one)).alias("row"),
        *[F.first(c).alias(c) for c in ("n_shingles", "bands")],
    )
    # From here on a class goes by a number, which is settled with the table.
    classes = stage(
        grouped.select(F.monotonically_increasing_id().alias("node"), "class", "row.*", "n_shingles", "bands")
    )
    keyed = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    candidates = stage(keyed.join(crowded, "key"))

    wanted = candidates.select("node").distinct().join(classes.select("node", "doc_id", "text_hash"), "node")
    sets = stage(full_sets(docs, stage(wanted), width).groupBy("node").agg(F.first("items").alias("items")))
    # What is a node's own is in no intersection, which rules out most pairs of copies that were changed
    # in many places.
    shared = F.col("n_shingles") - F.coalesce("own", F.lit(0))
    able = candidates.join(own_counts(sets), "node", "left").select("key", "node", "n_shingles", shared.alias("shared"))
    able = stage(able.where(100 * F.col("shared") >= percent * F.col("n_shingles")))
    # The centre is the member with the least of its own: what the others were copied from, if it is there.
    nearest = F.min(F.struct((1 - F.col("shared") / F.col("n_shingles")).alias("part"), "node", "n_shingles", "shared"))
    buckets = able.groupBy("key").agg(nearest.alias("near"), F.count(F.lit(1)).alias("held")).where("held > 1")
    centres = buckets.select("key", *[F.col(f"near.{a}").alias(b) for a, b in (("node", "centre"), ("n_shingles", "c_n_shingles"), ("shared", "c_shared"))])
    members = stage(able.join(centres, "key").where("node != centre"))
    stars = members.where(possible("", "c_", percent)).select("centre", "node").distinct()
    links = stage(confirmed(stars.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets, percent))
    joined = components(links)

    more = stage(links_between(members, joined, sets, percent))
    if not more.isEmpty():
        joined = components(joined.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))

    named = classes.select("node", "class", "doc_id")
    roots = joined.select("root").distinct().select(F.col("root").alias("node"), "root").unionByName(joined.select("node", "root"))
    of_root = roots.join(named, "node").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    lowest = roots.join(of_root, "root").select("node", "lowest", F.lit(True).alias("linked"))
    ids = stage(
        named.join(lowest, "node", "left").select(
            "class", F.when(F.col("linked"), F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")
        )
    )
    linked = some.join(ids, "class").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def links_between(members: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that no star has connected.

    Buckets of one centre are taken together, so that a pair meets once. One side of a pair is a member
    outside the centre's component, so a group costs the number of these times its size, and nothing
    once all its members are connected. Members meet in blocks of bounded size, with their full sets;
    pairs are compared within a task and only links become rows.
    """
    itself = members.select("centre", F.col("centre").alias("node"), F.col("c_shared").alias("shared"))
    grouped = members.select("centre", "node", "shared").unionByName(itself).distinct()
    rooted = grouped.join(joined.select("node", "root"), "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    centres = joined.select(F.col("node").alias("centre"), F.col("root").alias("main"))
    rooted = rooted.join(centres, "centre", "left").withColumn("main", F.coalesce("main", "centre"))
    several = rooted.groupBy("centre").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("shared").alias("items")
    ).where("low < high")
    blocks = several.select("centre", F.ceil(F.col("items") / BLOCK_ITEMS).alias("blocks"))
    held = stage(
        rooted.join(blocks, "centre").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))))
    )

    def in_blocks(rows: DataFrame, name: str) -> DataFrame:
        member = F.struct("node", "root", "shared", "items")
        return rows.groupBy("centre", "block").agg(F.collect_list(member).alias(name)).drop("block")

    met = in_blocks(held.where("root != main"), "some").join(in_blocks(held, "others"), "centre").select("some", "others")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                pairs = linked_pairs(batch.column(0)[row].values, batch.column(1)[row].values, percent)
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in pairs], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def linked_pairs(some: pa.StructArray, others: pa.StructArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a member of `some` and one of `others`, of different roots, whose sets are similar enough."""
    values = lambda side, name: side.field(name).to_numpy(zero_copy_only=False)
    items, sizes = others.field("items").flatten().to_numpy(), np.diff(others.field("items").offsets.to_numpy())
    order = np.argsort(items, kind="stable")
    items, owners = items[order], np.repeat(np.arange(len(others)), sizes)[order]
    nodes, roots, shared = values(others, "node"), values(others, "root"), values(others, "shared")
    left, right = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    own_items = some.field("items").flatten().to_numpy()
    ends = np.cumsum(np.diff(some.field("items").offsets.to_numpy()))
    for k, (node, root, own_shared) in enumerate(zip(values(some, "node"), values(some, "root"), values(some, "shared"), strict=True)):
        own = own_items[ends[k - 1] if k else 0 : ends[k]]
        most = np.minimum(shared, own_shared)
        able = (roots != root) & (100 * most >= percent * (sizes + len(own) - most))
        if not able.any():
            continue
        first, last = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
        counts = last - first
        places = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(owners[places], minlength=len(others))
        near = able & (100 * both >= percent * (sizes + len(own) - both))
        left.append(np.full(near.sum(), node))
        right.append(nodes[near])
    return np.concatenate(left), np.concatenate(right)


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component left, and all columns they came with.

    Of rows that repeat a document, the same doc_id and text, one stays.
    """
    hashed, nth, key, doc_id, text_hash, maybe = free_names(docs, ["hashed", "nth", "key", "found_id", "found_hash", "maybe"])
    found = stage(find(docs, width, percent).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), "kept"))
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(hashed, F.xxhash64("text"))
    same = F.col(hashed).eqNullSafe(F.col(text_hash)) & F.col(key).eqNullSafe(F.col(doc_id))
    gone = found.where("not kept").select(doc_id, text_hash).distinct()
    twice = found.where("kept").groupBy(doc_id, text_hash).agg(F.count(F.lit(1)).alias(nth)).where(F.col(nth) > 1).drop(nth)
    gone, twice = stage(gone), stage(twice)
    # Rows that are surely neither are not moved; the others are few and looked up.
    flagged = marked(rows, [key, hashed], gone.unionByName(twice), [doc_id, text_hash], maybe)
    doubtful = flagged.where(F.col(maybe)).join(gone, same, "left_anti")
    again = Window.partitionBy(key, hashed).orderBy(hashed)
    repeated = doubtful.join(twice, same, "left_semi").withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1)
    out = flagged.where(~F.col(maybe)).unionByName(doubtful.join(twice, same, "left_anti")).unionByName(repeated.drop(nth))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

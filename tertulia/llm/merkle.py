"""Merkle manifest of a dataset: a tree of hashes for each source, and one over the sources.

Every row is a leaf. Leaves are numbered within their source, and each level of all trees is built at once:
a node asks for the nodes at the computed sibling indices of its run, its own among them, by an equijoin on
tree and index, and the rows in slot zero of a run emit the parent. What a node found before and after it
in its run is its step of the proof; steps are handed down from the root, so the proof of a leaf is there
without walking up the tree for each.

Keys are tree and index, which are unique, so a source with most of the rows is dealt out like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.plans.staging import stage

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TREE_OF_SOURCES = ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(value: Column) -> Column:
    """A value such that no two rows of values read alike: `-` if missing, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[written(v) for v in values]), 256))


def shown(digests: Column) -> Column:
    """Digests as they are hashed and given out: lowercase hex."""
    return F.lower(F.hex(digests))


def lower_case(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def source_tree(source: Column) -> Column:
    """The name of a source's tree. Names sort as the sources do: the missing one first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with `index`, their place from 0 in the order of their group, and `size`, the group's rows.

    The rows are dealt out by range and sorted there, so a group may lie in many partitions; only the
    count of a group in a partition goes on to the running sums. `order` should tell rows apart.
    """
    placed = stage(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy(group, "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        group,
        "part",
        (F.col("low") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("origin"),
        F.sum("n").over(whole).alias("size"),
    )
    return placed.join(stage(starts), [group, "part"]).withColumn("index", F.col("at") - F.col("origin")).drop("at", "part", "origin")


def joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda all_, x: F.concat(all_, x))


def with_siblings(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Each node (tree, index, size, digest) of trees that have several, with the digests of its run that
    stand `before` and `after` it. `carried` columns are kept."""
    nodes = nodes.where("size > 1")
    slot = F.col("index") % ARITY
    shifts = F.sequence(F.lit(0), F.lit(ARITY - 1))
    siblings = F.transform(shifts, lambda shift: F.col("index") - slot + (slot + shift) % ARITY)
    wanted = nodes.select("tree", "size", F.col("index").alias("asking"), F.explode(siblings).alias("index")).where("index < size")
    own = F.col("asking") == F.col("index")
    found = wanted.join(nodes.drop("size"), ["tree", "index"]).select(
        "tree", "asking", "size", F.struct("index", "digest").alias("node"), *[F.when(own, F.col(c)).alias(c) for c in carried]
    )
    runs = found.groupBy("tree", "asking", "size").agg(
        F.array_sort(F.collect_list("node")).alias("run"), *[F.max(c).alias(c) for c in carried]
    )
    side = lambda keep: joined(F.transform(F.filter("run", lambda x: keep(x["index"])), lambda x: x["digest"]))
    return runs.select(
        "tree",
        F.col("asking").alias("index"),
        "size",
        F.get("run", F.col("asking") % ARITY)["digest"].alias("digest"),
        side(lambda i: i < F.col("asking")).alias("before"),
        side(lambda i: i > F.col("asking")).alias("after"),
        *carried,
    )


def parents(level: DataFrame) -> DataFrame:
    """The next level: the rows in slot zero emit the hash of their run."""
    return level.where(F.col("index") % ARITY == 0).select(
        "tree",
        F.expr(f"index div {ARITY}").alias("index"),
        F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"),
        F.unhex(F.sha2(shown(F.concat("digest", "after")), 256)).alias("digest"),
    )


def climb(nodes: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels above `nodes` up to the roots: the nodes of each with their siblings, and the roots
    (tree, digest) that each level has, the first of trees of one node."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels, roots = [], []
    while True:
        roots.append(nodes.where("size = 1"))
        if largest <= 1:
            return levels, roots
        levels.append(stage(with_siblings(nodes, () if levels else carried)))
        nodes, largest = parents(levels[-1]), -(-largest // ARITY)


NO_STEPS = "cast(array() as array<struct<before:binary,after:binary>>)"


def hand_down(levels: list[DataFrame], roots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's nodes with `steps`, the proof from there to the root, and all that `tops` (tree,
    steps and more) says of their tree."""
    ends = [r.drop("digest", "size").join(tops, "tree") for r in roots]
    known = ends[-1]
    more = [c for c in tops.columns if c not in ("tree", "steps")]
    for k in reversed(range(len(levels))):
        above = known.select("tree", F.col("index").alias("parent"), F.col("steps").alias("next"), *more)
        level = levels[k].withColumn("parent", F.expr(f"index div {ARITY}"))
        known = level.join(above, ["tree", "parent"]).withColumn("steps", F.concat(F.array(F.struct("before", "after")), "next"))
        if k:
            known = known.select("tree", "index", "steps", *more).unionByName(ends[k].select("tree", "index", "steps", *more))
    return known


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to, both in hex."""
    return F.aggregate(
        steps, leaf, lambda known, s: F.sha2(F.concat(shown(s["before"]), known, shown(s["after"])), 256)
    )


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, leaf, subroot, root, proof_sha256, folded_root and
    verified, digests in hex.

    Leaves ascend by doc_id within their source, missing ids first; rows of one id by their hash, and
    equal rows take a place each. Runs of 16 nodes are hashed to one while a tree has several nodes.
    `proof_sha256` is the hash of all siblings from the leaf to the root. `altered` is the text as a
    check finds it, null where it finds the recorded one: `folded_root` is what that text and the
    recorded siblings lead to, and `verified` whether that is the root.

    Missing values in any column have a hash of their own, unlike that of empty ones; rows without
    source are a source, the first. Texts are hashed whole, however long. No rows give no rows; other
    columns are ignored.
    """
    values = [F.col(c) for c in COLUMNS]
    found = F.lit(None).cast("string") if altered is None else altered
    text_found = [found if c == "text" else F.col(c) for c in COLUMNS]
    rows = stage(
        docs.select(
            source_tree(F.col("source")).alias("tree"),
            F.col("doc_id"),
            F.col("source"),
            leaf_hash(*values).alias("digest"),
            F.when(found.isNotNull(), leaf_hash(*text_found)).alias("altered"),
            F.monotonically_increasing_id().alias("row"),  # tells copies apart, so that ranges can cut them
        )
    )
    leaves = numbered(rows, "tree", ["doc_id", "digest", "row"]).drop("row")
    carried = ["doc_id", "source", "altered"]
    levels, roots = climb(leaves, carried)

    subroots = roots[0].select("tree", "digest")
    for r in roots[1:]:
        subroots = subroots.unionByName(r.select("tree", "digest"))
    named = subroots.select(F.lit(TREE_OF_SOURCES).alias("tree"), F.col("tree").alias("name"), "digest")
    sources = stage(numbered(named, "tree", ["name"]))
    over, top = climb(sources, ["name"])
    if over:
        # Staged, so that the tree's name is a column to join by.
        root = stage(top[-1].select("tree", F.expr(NO_STEPS).alias("steps"), F.col("digest").alias("root")))
        known = hand_down(over, top, root)
        tops = known.select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    else:
        tops = sources.select(F.col("name").alias("tree"), F.expr(NO_STEPS).alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = stage(tops)

    # A source of one row is its own root, and no level has it.
    columns = [*carried, "digest", "steps", "subroot", "root"]
    alone = roots[0].join(tops, "tree").select(*columns)
    proved = hand_down(levels, roots, tops).select(*columns).unionByName(alone) if levels else alone
    proof = F.array_join(F.transform("steps", lambda s: shown(F.concat(s["before"], s["after"]))), "")
    folded = proved.select(
        "doc_id",
        "source",
        shown(F.col("digest")).alias("leaf"),
        shown(F.col("subroot")).alias("subroot"),
        shown(F.col("root")).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        fold(shown(F.coalesce("altered", "digest")), F.col("steps")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Mixing sources to target weights.

The words of every source are taken as one stream and cut into blocks of equal length. The output is
dealt in shards: for each shard the number of blocks from each source is a multinomial draw, slot by
slot; draws beyond a source's quota are dealt again to sources that fell short, so each quota is met
exactly. The slots of a source are numbered, and a pseudorandom permutation of its block indexes, a
new one for each pass over the source, says which block goes into which slot. Slots and blocks meet in
a join on source and index.

All of it is DataFrame operations, and all draws are hashes, so a rerun gives the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.llm.columns import free_names, let
from tertulia.plans.staging import stage

WHITE = r"[\x20\x09-\x0D]+"
BUCKETS = 1024  # parts of a source that are numbered apart, so that a large one is no single task
SWAPS = 20


def count_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for a missing one."""
    inside = lambda parts: F.size(parts) - (parts[0] == "").cast("int") - (F.get(parts, F.size(parts) - 1) == "").cast("int")
    return F.greatest(F.coalesce(let(F.split(text, WHITE, -1), inside), F.lit(0)), F.lit(0)).cast("long")


def shuffled(index: Column, size: Column, *key: Column | int) -> Column:
    """A permutation of 0 .. size - 1 chosen by `key`, at `index`: the swap-or-not shuffle.

    Each round pairs x with k - x (mod size) and swaps the two or not by a hash of the larger, so it
    is a bijection for every size.
    """
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), size) + size - x, size)
        return F.when(F.xxhash64(F.greatest(x, other), *keys, r) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), index.cast("long"), swap)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row for each source with its size, number of blocks' worth and target.

    Sources by code point, missing ones last, take the weights in turn. All share `share` times the
    total; a target stops at `most` times its source's size and the excess goes to the others by
    weight, until none is above. Hence target = min(weight * level, most * size): with the sources
    in the order in which they are capped, the level is that of the first one that need not be.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(nth, F.lit(len(weights))))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", (total - capped) / sharing)
    free = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_free = F.first(free, ignorenulls=True).over(everywhere)
    target = F.least(F.col("weight") * F.coalesce(first_free, F.lit(float("inf"))), F.col("cap"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


@dataclass(frozen=True)
class Mix:
    """Tables of a mix, staged, so that all that is read from it agrees.

    sources   source, source_size, target, blocks, quota (slots it gets)
    spans     row_id, doc_id, source, size, start (its first word in the source's stream)
    slots     shard, source, number (of the slot among those of its source), pass, block
    block     words in a block; the last one of a source may hold fewer
    """

    sources: DataFrame
    spans: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """The part of each row that lies in each block: row_id, source, block, from_word, to_word."""
        first, last = F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block)
        cut = self.spans.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        begin = F.greatest(F.col("block") * self.block - F.col("start"), F.lit(0).cast("long"))
        end = F.least((F.col("block") + 1) * self.block - F.col("start"), F.col("size"))
        return cut.select("row_id", "source", "block", begin.alias("from_word"), end.alias("to_word"))

    def taken(self) -> DataFrame:
        """How many words of each row the mix takes, repeats counted; rows of which it takes none are left out."""
        uses = self.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
        words = (F.col("to_word") - F.col("from_word")) * F.col("uses")
        return joined(self.pieces(), uses, "source", "block").groupBy("row_id").agg(F.sum(words).alias("taken"))


def joined(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on keys that may be missing; the columns of `left`, then the others of `right`."""
    other = right.select(*[F.col(k).alias(f"right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"right_{k}" for k in keys])


def streams(sizes: DataFrame) -> DataFrame:
    """`sizes` with `start`, the words that come before a row in its source, in an order set by hashes."""
    bucketed = sizes.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    parts = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined(bucketed, starts, "source", "bucket")
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return placed.withColumn("start", start).drop("bucket", "bucket_start", "hash")


def spread_out(rows: DataFrame, key: str) -> DataFrame:
    """Deal out rows that each become many. Without a number of partitions, adaptive execution would
    join them into one, going by the size they have before."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def draw_slots(sources: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """Every slot of the output with its source and its number among the slots of that source.

    Each slot draws a source with the probability of the source's share of the quotas, which makes
    the counts of a shard multinomial. A source's slots are numbered through the shards; numbers from
    the quota on are surplus, and the surplus, numbered in turn, fills the ranges that are missing.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ranges = sources.where("quota > 0").select("source", "quota", F.sum("quota").over(by_source).alias("until"))
    table = ranges.agg(F.array_sort(F.collect_list(F.struct("until", "source")))).scalar()
    total = ranges.agg(F.coalesce(F.sum("quota"), F.lit(0))).scalar()
    spark = sources.sparkSession
    per_shard = F.lit(shard_slots).cast("long")
    shards = spark.range(1).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(total, F.lit(1).cast("long")) - 1) / per_shard))).alias("shard")
    )
    slots = spread_out(shards, "shard").select(
        "shard", F.explode(F.sequence(F.col("shard") * per_shard, F.least((F.col("shard") + 1) * per_shard, total) - 1)).alias("slot")
    ).where(F.col("slot") < total)
    drawn = slots.select("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("slot")), total).alias("at"), table.alias("ranges"))
    chosen = F.get(F.filter("ranges", lambda r: r["until"] > F.col("at")), F.lit(0))["source"]
    counts = stage(drawn.groupBy("shard", chosen.alias("source")).agg(F.count(F.lit(1)).alias("n")))

    through = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(through), F.lit(0))
    numbered = joined(counts.withColumn("first", first), sources.select("source", "quota"), "source")
    fitting = F.greatest(F.least(F.col("n"), F.col("quota") - F.col("first")), F.lit(0).cast("long"))
    split = numbered.select("shard", "source", "first", fitting.alias("fits"), (F.col("n") - fitting).alias("over"))
    few = spread_out(split.where("fits > 0"), "shard")
    kept = few.select("shard", "source", F.explode(F.expr("sequence(first, first + fits - 1)")).alias("number"))

    given = counts.groupBy("source").agg(F.sum("n").alias("given"))
    short = joined(sources.select("source", "quota"), given, "source", how="left").select(
        "source", F.coalesce("given", F.lit(0)).alias("given"), F.greatest(F.col("quota") - F.coalesce("given", F.lit(0)), F.lit(0)).alias("lacks")
    ).where("lacks > 0")
    missing = short.withColumn("until", F.sum("lacks").over(by_source))
    gaps = missing.agg(F.array_sort(F.collect_list(F.struct("until", "lacks", "given", "source")))).scalar()
    in_turn = Window.orderBy("shard", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    surplus = split.where("over > 0").withColumn("turn", F.coalesce(F.sum("over").over(in_turn), F.lit(0)))
    spread = surplus.select("shard", F.explode(F.expr("sequence(turn, turn + over - 1)")).alias("turn"))
    gap = F.get(F.filter("gaps", lambda g: g["until"] > F.col("turn")), F.lit(0))
    dealt_again = spread.withColumn("gaps", gaps).select("shard", gap.alias("gap"), "turn").select(
        "shard",
        F.col("gap.source").alias("source"),
        (F.col("gap.given") + F.col("turn") - (F.col("gap.until") - F.col("gap.lacks"))).alias("number"),
    )
    return kept.unionByName(dealt_again)


def mix(
    sizes: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_slots: int = 1024,
    seed: int = 17,
) -> Mix:
    """Mix rows of row_id, doc_id, source, size and hash.

    A quota is the target in blocks, rounded, and is never more than `most` passes over the source.
    The table of sources is read whole where a slot is drawn, so it should stay in the thousands.
    """
    spans = stage(streams(sizes))
    with_target = targets(spans, weights, share, most)
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * blocks), F.floor(most * blocks)))
    sources = stage(with_target.withColumn("blocks", blocks).withColumn("quota", F.coalesce(quota, F.lit(0)).cast("long")))
    slots = joined(draw_slots(sources, seed, shard_slots), sources.select("source", "blocks"), "source")
    turn = F.floor(F.col("number") / F.col("blocks"))
    index = shuffled(F.col("number") % F.col("blocks"), F.col("blocks"), seed, F.coalesce("source", F.lit("")), turn)
    return Mix(sources, spans, slots.select("shard", "source", "number", turn.alias("pass"), index.alias("block")), block)


def measured(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """What `mix` takes, for documents with doc_id, source and text."""
    return docs.select(
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        count_words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("hash"),
    )


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target and taken.

    A missing or empty text has no words and nothing is taken of it; documents without a source form
    one of their own, the last; equal rows are rows of their own, and between them it is open which
    one gets which share; no rows give no rows; other columns are ignored.
    """
    done = mix(stage(measured(docs)), **options)
    with_taken = done.spans.join(done.taken(), "row_id", "left")
    of_source = joined(with_taken, done.sources.select("source", "source_size", "target"), "source")
    return of_source.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block: int = 512, **options) -> DataFrame:
    """The mix as rows of `docs`: a row for each pass in which any of a document's blocks is taken.

    A document whose blocks are all taken in a pass stays as it is; of another one the words in the
    blocks taken are kept, with the white space before each. `n_chars`, if there, follows the text.
    Texts without words are not taken. Documents are staged with a number, which is what their parts
    are joined on, so rows may be equal or lack any value.
    """
    row, cut, kept = free_names(docs, ["row", "cut", "kept"])
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    done = mix(stage(measured(numbered, row)), block=block, **options)
    part = F.struct("from_word", "to_word")
    words = F.sum(F.col("to_word") - F.col("from_word"))
    parts = joined(done.pieces(), done.slots.select("source", "block", "pass"), "source", "block")
    uses = parts.groupBy("row_id", "pass").agg(F.array_sort(F.collect_list(part)).alias(cut), words.alias(kept))
    whole = uses.join(done.spans.select("row_id", "size"), "row_id").select(
        F.col("row_id").alias(row), F.when(F.col(kept) < F.col("size"), F.col(cut)).alias(cut)
    )
    found = numbered.join(whole, row)
    tokens = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    of_part = lambda all_words: F.transform(
        F.col(cut), lambda p: F.array_join(F.slice(all_words, (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")), "")
    )
    shortened = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(let(tokens, of_part), ""))
    out = found.withColumn("text", shortened)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

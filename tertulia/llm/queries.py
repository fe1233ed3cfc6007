"""The operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tertulia.llm
from tertulia.llm import backoff, chat, licenses, merkle, minmax, mixing, multiindex, packing, pii, pivots, quality, repair, urls
from tertulia.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

# Workers need not have this repository on their path.
cloudpickle.register_pickle_by_value(tertulia.llm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    words, base = F.col("places.word"), F.col("places.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("blocks.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
        .alias("score"),
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = chat.read_loss(chat.format_chats(chat.as_events(rows.unionByName(probe))))
    read = formatted.withColumn("turns", chat.read_turns(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_kind(F.col("spans"), k.name).alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(pii.written(F.filter("spans", pii.is_base)), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op10_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.find(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.find(table(spark, sf_dir, "embeddings"), least=0.98)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), F.when(tampered, merkle.lower_case(F.col("text")))).drop("source")


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with rows dropped, emptied, cut off, repeated or given to the user, by a hash of conv_id and turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), which.alias("which"))
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("which") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("which") == 3, 2).otherwise(1))
    changed = rows.where("which <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return changed.drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.summary(repair.repair(damaged(conversations))).withColumnRenamed("conv_id", "repaired_id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_urls": op2_urls,
    "op3_backoff": op3_backoff,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_multiindex": op7_multiindex,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_minmax": op10_minmax,
    "op11_pivots": op11_pivots,
    "op12_merkle": op12_merkle,
    "op13_repair": op13_repair,
}

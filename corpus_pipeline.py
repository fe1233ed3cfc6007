"""From raw documents to packed sequences, in five stages.

A stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tertulia.llm import minmax, mixing, packing, pii, quality
from tertulia.plans.staging import stage_result


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision takes for good; the others go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minmax.keep_first(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 in turn: a row for each pass over a document, with the words taken."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the fitted rules nor the tokens. tests/llm/test_pipeline.py checks which documents each
#: stage leaves, the mix and the pieces; the rows of run() have no brute-force version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage_result(spark, lambda function=function, docs=docs: function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

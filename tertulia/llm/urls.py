"""URL filters: a ratio of character language models for accepted and rejected URLs.

Rules on host and path decide the URLs they fit, and those train two variable-order Markov models of
characters, one for each verdict. A URL that no rule fits is judged by the difference of its two
log-likelihoods divided by its length, against a threshold calibrated on URLs that were kept out of
the training.

Contexts are at most ORDER characters over an alphabet of 40, which bounds the tables that reach the
driver and the tasks: 40**ORDER contexts of 40 characters, 2.56 million counts a class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.llm.columns import free_names

#: (verdict, host, beginning of the path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 3
_KNOWN = "abcdefghijklmnopqrstuvwxyz0123456789.-/"
ALPHABET = len(_KNOWN) + 1
BINS = 4096
KEPT_OUT = 5  # one URL in so many calibrates instead of training


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*+)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as verdict and text; null if none does."""

    def fits(rule: tuple[str, str, str]) -> Column:
        _, name, begin = rule
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    options = [F.when(fits(r), F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1] + r[2]).alias("rule"))) for r in ordered]
    return F.coalesce(*options) if options else F.lit(None).cast("struct<verdict string, rule string>")


def symbols(text: str) -> str:
    """`text` over the models' alphabet: lower-cased, with ~ for all other characters."""
    return "".join(c if c in _KNOWN else "~" for c in text.lower())


_NUMBER = bytes(_KNOWN.index(chr(i)) if chr(i) in _KNOWN else len(_KNOWN) for i in range(256))


def numbers_of(text: str) -> np.ndarray:
    """The symbols of `text` as numbers below ALPHABET."""
    return np.frombuffer(symbols(text).encode("ascii").translate(_NUMBER), np.uint8).astype(np.int64)


def places_of(numbers: np.ndarray, order: int) -> list[np.ndarray]:
    """For each context length up to `order`, the places in its table of the characters that have it: those
    near the beginning have the whole beginning as context, all others `order` characters."""
    found, place = [], numbers
    for k in range(order + 1):
        if k:
            place = numbers[: max(len(numbers) - k, 0)] * ALPHABET**k + place[1:]
        found.append(place if k == order else place[:1])
    return found


@dataclass(frozen=True)
class MarkovModel:
    """Counts of characters after contexts of 0 to `order` characters.

    `counts[k]` has a row for each context of k characters and a column for each next one; a context is the
    number that its characters write in base ALPHABET.
    """

    counts: Sequence[np.ndarray]

    @staticmethod
    def of(grams: Iterable[tuple[str, int]], order: int = ORDER) -> MarkovModel:
        counts = [np.zeros((ALPHABET**k, ALPHABET)) for k in range(order + 1)]
        for gram, n in grams:
            place = 0
            for number in gram.encode("ascii").translate(_NUMBER):
                place = place * ALPHABET + number
            counts[len(gram) - 1].flat[place] += n
        return MarkovModel(counts)

    def logarithms(self) -> list[np.ndarray]:
        """Logarithms of the probabilities, a table for each context length. Witten-Bell: each order is
        mixed with the shorter one by how often it saw a new character."""
        p, found = np.full((1, ALPHABET), 1.0 / ALPHABET), []
        for k, counts in enumerate(self.counts):
            shorter = np.tile(p, (ALPHABET, 1)) if k else p
            total, kinds = counts.sum(axis=1, keepdims=True), np.count_nonzero(counts, axis=1, keepdims=True)
            p = np.where(total > 0, (counts + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
            found.append(np.log(p).reshape(-1))
        return found


def grams_of(text: str, order: int = ORDER) -> Iterator[str]:
    for i in range(len(text)):
        for k in range(min(order, i) + 1):
            yield text[i - k : i + 1]


def count_grams(texts: DataFrame, order: int = ORDER) -> dict[str, MarkovModel]:
    """A model for each value of the first column, trained on the strings in the second."""
    schema = pa.schema([("verdict", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for verdict, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((verdict, g) for g in grams_of(symbols(text), order))
        keys = list(seen)
        columns = [[k[0] for k in keys], [k[1] for k in keys], list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    counted = texts.mapInArrow(count, "verdict string, gram string, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    known, found = counted.toArrow(), {}
    for verdict in ("allow", "block"):
        own = known.filter(pc.equal(known.column("verdict"), verdict)).select(["gram", "n"]).to_batches(max_chunksize=10_000)
        found[verdict] = MarkovModel.of((pair for b in own for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)), order)
    return found


def score_with(spark: SparkSession, accepted: MarkovModel, rejected: MarkovModel):
    """Log-likelihood under `accepted` less that under `rejected`, per character; 0 for an empty string.

    Tasks hold one number for each context and next character: 21 MB for contexts of up to 3."""
    order = len(accepted.counts) - 1
    ratios = spark.sparkContext.broadcast([a - r for a, r in zip(accepted.logarithms(), rejected.logarithms(), strict=True)])

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            numbers = numbers_of(text)
            total = sum(float(ratio[at].sum()) for ratio, at in zip(ratios.value, places_of(numbers, order), strict=True))
            found.append(total / len(numbers) if len(numbers) else 0.0)
        return pd.Series(found, dtype="float64")

    return score


def calibrate(scored: DataFrame) -> float:
    """The threshold that judges most URLs of known verdict rightly, both verdicts counting alike.

    Scores lie within +-log of the alphabet over the smallest probability, in practice within +-8, and
    are counted in BINS; scores beyond fall into the outer bins. Of thresholds that do equally well
    the one in the middle of the longest run is taken; without URLs of both verdicts it is 0.
    """
    width = 16.0 / BINS
    bin_of = F.least(F.greatest(F.floor((F.col("score") + 8) / width), F.lit(0)), F.lit(BINS - 1))
    counts = {"allow": [0] * BINS, "block": [0] * BINS}
    for r in scored.groupBy("verdict", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["verdict"]][r["bin"]] = r["n"]
    allowed, blocked = sum(counts["allow"]), sum(counts["block"])
    if not allowed or not blocked:
        return 0.0
    right, best = [1.0], []
    for a, b in zip(counts["allow"], counts["block"], strict=True):  # threshold above this bin
        right.append(right[-1] - a / allowed + b / blocked)
    top, run = max(right), []
    for i, r in enumerate([*right, -1.0]):
        if abs(r - top) < 1e-9:
            run.append(i)
        else:
            best, run = max(best, run, key=len), []
    return best[len(best) // 2] * width - 8


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """A row for each page: its key, host, path, rule (null if none fits), score and verdict.

    The models read host and path without the part of the host that rules name, so that they learn
    something that carries over. A missing URL, or one without ://, has an empty host and path and a
    score of 0; equal rows give equal rows; no rows give none; other columns are ignored. Whether a
    URL trains or calibrates is decided by a hash of it.
    """
    chosen, seen = free_names(pages, ["chosen", "seen"])
    split = pages.select(F.col(key).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    names = sorted({name for _, name, _ in rules}, key=len, reverse=True)
    bare = reduce(lambda h, name: F.regexp_replace(h, rf"(^|\.){name.replace('.', r'[.]')}$", ""), names, F.col("host"))
    judged = split.withColumn(chosen, rule_for(F.col("host"), F.col("path"), rules)).withColumn(seen, F.concat(bare, F.col("path")))
    known = judged.where(F.col(chosen).isNotNull()).select(F.col(f"{chosen}.verdict").alias("verdict"), F.col(seen).alias("text"))
    apart = F.pmod(F.xxhash64("text"), F.lit(KEPT_OUT)) == 0
    models = count_grams(known.where(~apart), order)
    score = score_with(pages.sparkSession, models["allow"], models["block"])
    threshold = calibrate(known.where(apart).select("verdict", score("text").alias("score")))
    scored = judged.withColumn("score", score(F.col(seen)))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", F.col(f"{chosen}.rule").alias("rule"), "score", F.coalesce(F.col(f"{chosen}.verdict"), by_model).alias("verdict")
    )

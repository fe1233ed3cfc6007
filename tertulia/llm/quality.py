"""Quality rules as weak supervision.

Each rule votes for or against a document or abstains. Expectation-maximisation on the votes of all
documents estimates how often each rule is right on good and on bad documents, and a document's
posterior probability of being good replaces "all rules must pass".

The votes of k rules take at most 3**k patterns, so the table EM works on is bounded whatever the
number of documents: Spark counts the patterns, the driver fits the model on the counts, and the
posterior of every pattern is joined back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tertulia.llm.columns import free_name
from tertulia.plans.staging import stage

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouted", "top_word",
)
_SYMBOLS = b"#*$%&|<>"
_LOWER, _UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter((number[w] for w in words), np.int64, len(words))
    windows = ids[:n]
    for k in range(1, width):
        if (int(windows.max()) + 1) * len(number) >= 2**62:  # keep the combined number exact
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * len(number) + ids[k : k + n]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The figures of MEASURES for one whole text; all zero for a missing or empty one.

    Letters are those of ASCII, counted for the share of capitals.
    """
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    joined = b"".join(words)
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _LOWER + _UPPER)),
        len(raw) - len(raw.translate(None, _UPPER)),
        raw.count(b"!!"),
        max(Counter(words).values(), default=0),
    )


@F.pandas_udf(StructType([StructField(name, LongType()) for name in MEASURES]))
def measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")


@dataclass(frozen=True)
class Rule:
    """Votes against where `top` / `per` is above `bad`, for where it is below `good`, else abstains.

    Below `least` of `per` there is too little to tell, and the rule abstains.
    """

    name: str
    top: str
    per: str
    good: float
    bad: float
    least: int = 20

    def vote(self, m: Column) -> Column:
        share = m[self.top] / m[self.per]
        vote = F.when(share > self.bad, "-").when(share < self.good, "+").otherwise("0")
        return F.when(m[self.per] >= self.least, vote).otherwise("0")


#: A document of prose keeps clear of every `bad` bound; between the bounds a rule abstains.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.10),
    Rule("repeats", "n_repeat_words", "n_words", 0.10, 0.30),
    Rule("duplicate lines", "n_dup_lines", "n_lines", 0.05, 0.40, least=5),
    Rule("capitals", "n_upper", "n_letters", 0.20, 0.50),
    Rule("shouting", "n_shouted", "n_words", 0.01, 0.10),
    Rule("one word", "top_word", "n_words", 0.15, 0.25),
    Rule("long words", "word_chars", "n_words", 9.0, 16.0),
)


def votes(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """One character a rule: + for, - against, 0 abstains."""
    return F.concat(*[rule.vote(m) for rule in rules])


@dataclass(frozen=True)
class RuleModel:
    """`good`, `right_on_good` and `right_on_bad`: share of good documents, accuracy of each rule on
    good and on bad documents; `posterior`: probability of being good, for each pattern of votes."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]
    posterior: dict[str, float]


def fit(patterns: dict[str, int], n_rules: int, rounds: int = 100) -> RuleModel:
    """Expectation-maximisation on counted vote patterns.

    Rules are taken as independent given the class, and abstaining as saying nothing. Junk comes in
    kinds that trip one rule each, so a rule need not be right on most bad documents; it must only
    speak against a bad one at least twice as often as against a good one, and against at most two
    good documents in a thousand. These bounds, the start, pseudo-counts of 20 documents a class and
    the assumption that at least half of all documents are good fix which class is which, also where
    there are few documents or none.
    """
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    table = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in names]).reshape(len(names), n_rules)
    plus, minus = table > 0, table < 0
    good, a, b = 0.8, np.full(n_rules, 0.999), np.full(n_rules, 0.3)

    def posterior() -> np.ndarray:
        if_good = np.log(good) + plus @ np.log(a) + minus @ np.log(1 - a)
        if_bad = np.log(1 - good) + plus @ np.log(1 - b) + minus @ np.log(b)
        return 1 / (1 + np.exp(np.clip(if_bad - if_good, -700, 700)))

    for _ in range(rounds):
        p = posterior()
        yes, no = n * p, n * (1 - p)
        good = np.clip((yes.sum() + 16) / (n.sum() + 20), 0.5, 0.99)
        a = np.clip((yes @ plus + 19.98) / (yes @ (plus | minus) + 20), 0.998, 0.9999)
        b = np.clip((no @ minus + 6) / (no @ (plus | minus) + 20), 2 * (1 - a), 0.999)
    return RuleModel(float(good), tuple(map(float, a)), tuple(map(float, b)), dict(zip(names, map(float, posterior()), strict=True)))


def fit_votes(voted: DataFrame, col: str, n_rules: int) -> RuleModel:
    """Fit on a column of votes; at most 3**n_rules counts reach the driver."""
    counted = voted.groupBy(F.col(col).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return fit({r["pattern"]: r["n"] for r in counted.collect()}, n_rules)


def posterior_of(pattern: Column, model: RuleModel) -> Column:
    """Posterior by vote pattern, from a constant map of at most 3**k entries."""
    if not model.posterior:
        return F.lit(1.0)
    entries = [F.lit(x) for pair in sorted(model.posterior.items()) for x in pair]
    return F.create_map(*entries)[pattern]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows of `docs` whose text the model takes for good, with the columns they came with.

    Rejected are texts that fail the base rules (under 50 words, or more than half of the words in
    repeated windows) and those whose posterior is below `least`. A missing text has no words and
    goes; equal rows are judged alike and all stay or all go; no rows give no rows. The text is
    measured twice, once for the model and once for the verdict, rather than moved.
    """
    m = free_name(docs, "measures")
    rows = docs.withColumn(m, measured(F.col(f"`{text}`")))
    model = fit_votes(rows.select(votes(F.col(m), rules).alias("votes")), "votes", len(rules))
    good = posterior_of(votes(F.col(m), rules), model) >= least
    return rows.where(~base_failed(F.col(m)) & good).drop(m)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, rules: Sequence[Rule] = RULES) -> DataFrame:
    """A row for each document: its key, figures, votes, posterior, `base_failed` and `kept`.

    Missing and empty texts have no words: all figures are zero and the base rules fail. Equal rows
    give equal rows, and other columns of `docs` are ignored. The figures, a few numbers a document,
    are staged, so that the texts are read once.
    """
    figures = stage(docs.select(F.col(key).alias("doc_id"), measured(F.col(text)).alias("m")))
    voted = figures.withColumn("votes", votes(F.col("m"), rules))
    model = fit_votes(voted, "votes", len(rules))
    judged = voted.withColumn("posterior", posterior_of(F.col("votes"), model))
    failed = base_failed(F.col("m"))
    kept = ~failed & (F.col("posterior") >= least)
    return judged.select("doc_id", "m.*", "votes", "posterior", failed.alias("base_failed"), kept.alias("kept"))

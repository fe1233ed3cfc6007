"""Personal data: regular expressions propose spans, checksums confirm them, context sets the score.

All of it is column expressions. Spark's functions give the matches of an expression but not their
places; these follow from the lengths of the matches and of what lies between them. No expression can
match across a line end, and all are written so that no text makes them backtrack over long runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.llm.columns import free_name, let

CHUNK = 128
NEAR = 40  # characters on either side of a span that are searched for context words


def running_sums(steps: Column) -> Column:
    """Sums of the first 1, 2, ... elements. Made in chunks, since appending copies the array."""

    def chunk(c: Column) -> Column:
        return F.slice(steps, (c * CHUNK + 1).cast("int"), F.lit(CHUNK))

    def appended(start: Column) -> Callable[[Column, Column], Column]:
        return lambda sums, x: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), start) + x))

    none = F.array().cast("array<int>")
    chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
    totals = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda a, x: a + x))
    ends = let(totals, lambda t: F.aggregate(t, none, appended(F.lit(0))))
    sums = let(
        ends,
        lambda e: F.flatten(
            F.transform(chunks, lambda c: F.aggregate(chunk(c), none, appended(F.when(c > 0, F.get(e, c - 1)).otherwise(0))))
        ),
    )
    return F.when(F.size(steps) > 0, sums).otherwise(none)


def located(text: Column, pattern: str) -> Column:
    """Matches of `pattern`, leftmost and not overlapping, with start and end in code points."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
    )

    def places(f: Column) -> Column:
        steps = F.transform(
            f["matches"],
            lambda m, i: F.get(f["gaps"], i) + F.when(i > 0, F.length(F.get(f["matches"], i - 1))).otherwise(0),
        )
        return let(
            let(steps, running_sums),
            lambda starts: F.transform(
                f["matches"],
                lambda m, i: F.struct(
                    F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("match")
                ),
            ),
        )

    return let(found, places)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def always(match: Column) -> Column:
    return F.lit(True)


def small_parts(match: Column) -> Column:
    """Four numbers of at most 255, leading zeros aside."""
    plain = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255))


def luhn(match: Column) -> Column:
    """Every second digit from the right is doubled; the digits of all must add up to a multiple of ten."""
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    values = F.transform(F.split(F.reverse(digits(match)), ""), lambda d, i: doubled(d.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def phone_length(match: Column) -> Column:
    return F.length(digits(match)).between(10, 15)


def mod_97(match: Column) -> Column:
    """Country and check digits go to the end, letters count from 10; the number must leave 1."""
    plain = F.replace(match, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(c >= "A", 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """What proposes a span, what confirms it, and its score without and with a context word nearby."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    near: float = 1.0
    context: str = ""


#: The lookbehinds let a match begin at the start of a run only (for addresses, also right after the
#: last match), which is where the leftmost match begins; without them every place in a long run would
#: be tried.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

BASE = (
    Kind("email", EMAIL, always, 0.9, context=r"mail|contact|write to"),
    Kind("ip", IP, small_parts, 0.7, context=r"\bip\b|address|server|host"),
    Kind("card", CARD, luhn, 0.8, context=r"card|visa|master|credit|pay"),
    Kind("phone", PHONE, phone_length, 0.8, context=r"phone|call|tel|mobile|fax"),
)
#: Found besides; the last ones count only beside a context word.
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod_97, 0.8, context=r"iban|account|bank"),
    Kind("key", r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])", always, 0.9),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", always, 0.3, 0.8, r"\bssn\b|social security"),
    Kind("local_phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", always, 0.3, 0.7, r"phone|\bcall\b|\btel\b|mobile|\bfax\b"),
)


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """Confirmed spans of one kind, with their score."""

    def scored(span: Column) -> Column:
        around = F.substring(text, F.greatest(span["start"] + 1 - NEAR, F.lit(1)), span["end"] - span["start"] + 2 * NEAR)
        near = F.lower(around).rlike(kind.context) if kind.context else F.lit(False)
        return F.struct(
            span["start"].alias("start"),
            F.lit(order).alias("order"),
            span["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.when(near, kind.near).otherwise(kind.score).alias("score"),
        )

    confirmed = F.filter(located(text, kind.pattern), lambda s: kind.confirmed(s["match"]))
    return F.transform(confirmed, scored)


def spans(text: Column, kinds: Sequence[Kind] = BASE + MORE, least: float = 0.5) -> Column:
    """All spans of a text with a score of at least `least`, by start and then kind as listed.

    A missing text is empty. Spans of different kinds may overlap; those of MORE are left out where
    a span of BASE that is returned already covers them.
    """
    whole = F.coalesce(text, F.lit(""))

    def all_of(t: Column) -> Column:
        found = [spans_of(t, kind, i) for i, kind in enumerate(kinds)]
        return F.array_sort(F.filter(F.concat(*found), lambda s: s["score"] >= least))

    def uncovered(found: Column) -> Column:
        covers = lambda b, s: (b["start"] <= s["start"]) & (b["end"] >= s["end"])
        return let(F.filter(found, is_base), lambda base: F.filter(found, lambda s: is_base(s) | ~F.exists(base, lambda b: covers(b, s))))

    return let(let(whole, all_of), uncovered)


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """A row for each document, its key and its spans.

    A missing or empty text has none, equal rows give equal rows, and columns other than doc_id and
    text are ignored. Long texts are searched whole.
    """
    return docs.select(F.col("doc_id").cast("long"), spans(F.col("text"), least=least).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; overlapping spans are replaced as one."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.when(fresh, F.concat(state["parts"], F.array(before, mark))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    return F.aggregate(found, start, step, whole)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", least: float = 0.5) -> DataFrame:
    """`docs` with personal data replaced in `text`, and `n_chars`, if there, brought up to date.

    Texts without a span stay as they are, missing ones too; all rows stay.
    """
    before = free_name(docs, "before")
    old, new = F.col(before), F.col(f"`{text}`")
    replaced = let(spans(old, least=least), lambda found: F.when(F.size(found) > 0, redacted(old, found)).otherwise(old))
    out = docs.withColumn(before, new).withColumn(text, replaced)
    if n_chars in docs.columns:
        now = F.length(new).cast(docs.schema[n_chars].dataType)
        out = out.withColumn(n_chars, F.when(new.eqNullSafe(old), F.col(f"`{n_chars}`")).otherwise(now))
    return out.drop(before)


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def is_base(span: Column) -> Column:
    return reduce(lambda a, b: a | b, [span["kind"] == k.name for k in BASE])

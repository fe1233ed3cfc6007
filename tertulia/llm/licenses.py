"""License scans: an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of words. A template is a set of words, and a block matches it
when it contains at least `threshold` of them, those that name its license included. The words of templates and blocks are put in one
order, rare ones first as counted over the whole corpus, so that few blocks are looked at:

- prefix filter: a block that holds `need` of a template's words holds one of the template's first
  size - need + 1 words, so only those are indexed;
- length filter: a block with fewer than `need` words that occur in templates cannot match;
- positional filter: words before the first common one are not common, which bounds the overlap.

What passes is counted exactly. Blocks overlap by half, so a passage of up to half a block and one
word lies whole in one of them. Phrases are templates that must be contained entirely; their places
are then found word by word within the matching blocks.

The templates are a fixed, small list, so their index goes to every task and no text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.llm.words import alnum_words

#: Words that must stand consecutively, and the label they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which a license shows itself.
NOTICES = {
    "all rights reserved": "reserved",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc",
    "licensed under a creative commons attribution license": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Words that name a license. A block that lacks one its notice holds is another license's, however near.
NAMING = frozenset(("mit", "apache", "gnu", "lesser", "mozilla", "cc", "creative", "unencumbered"))

BLOCK = 64
FOUND = (
    "doc_id long, n_words long, places array<struct<label string, word long>>, "
    "blocks array<struct<label string, first_word long, containment double>>"
)


@dataclass(frozen=True)
class Template:
    """`words` in corpus order, rare first, of which a block holds `need` and all of `names`; `phrase` in reading
    order, for an exact phrase only."""

    label: str
    words: tuple[bytes, ...]
    need: int
    names: frozenset[bytes]
    phrase: tuple[bytes, ...] = ()


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(self, counts: Mapping[bytes, int], threshold: float, phrases: Mapping[str, str], notices: Mapping[str, str]):
        vocabulary = {w for text in [*phrases, *notices] for w in alnum_words(text)}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.templates = [self._template(text, label, 1.0, True) for text, label in phrases.items()]
        self.templates += [self._template(text, label, threshold, False) for text, label in notices.items()]
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for i, word in enumerate(template.words[: len(template.words) - template.need + 1]):
                self.prefixes.setdefault(word, []).append((t, i))

    def _template(self, text: str, label: str, threshold: float, exact: bool) -> Template:
        words = alnum_words(text)
        distinct = tuple(sorted(set(words), key=self.rank.__getitem__))
        names = frozenset(w for w in distinct if w.decode() in NAMING)
        return Template(label, distinct, needed(len(distinct), threshold), names, tuple(words) if exact else ())

    def matches(self, block: Sequence[bytes]) -> list[tuple[Template, int]]:
        """Templates that `block` contains far enough, each with the number of common words."""
        held = {w for w in block if w in self.rank}
        record = sorted(held, key=self.rank.__getitem__)
        candidates = set()
        for i, word in enumerate(record):
            for t, j in self.prefixes.get(word, ()):
                template = self.templates[t]
                if len(record) >= template.need and 1 + min(len(record) - i, len(template.words) - j) > template.need:
                    candidates.add(t)
        found = []
        for t in sorted(candidates):
            common = len(held.intersection(self.templates[t].words))
            if common >= self.templates[t].need and self.templates[t].names <= held:
                found.append((self.templates[t], common))
        return found

    def scan(self, words: Sequence[bytes], block: int = BLOCK) -> tuple[list[tuple[str, int]], list[tuple[str, int, float]]]:
        """Places of phrases as (label, first word), and matching blocks as (label, first word, containment)."""
        step = block // 2
        near = {i // step for i, w in enumerate(words) if w in self.prefixes}
        places, blocks = [], []
        for b in sorted(near | {b - 1 for b in near if b}):
            start = b * step
            inside = words[start : start + block]
            for template, common in self.matches(inside):
                k = len(template.phrase)
                if not k:
                    blocks.append((template.label, start, common / len(template.words)))
                    continue
                phrase = list(template.phrase)
                places += [(template.label, start + i) for i in range(min(step, len(inside))) if inside[i : i + k] == phrase]
        return places, blocks


def needed(size: int, threshold: float) -> int:
    """The least number of common words that reaches `threshold`."""
    return next(n for n in range(1, size + 1) if n >= threshold * size)


def count_words(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each word of `vocabulary` occurs in the corpus; one count a word reaches the driver."""
    wanted = frozenset(vocabulary)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(w for w in alnum_words(value.as_py()) if w in wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    counted = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(
    docs: DataFrame,
    threshold: float = 0.8,
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    block: int = BLOCK,
) -> DataFrame:
    """A row for each document: its words, the places of phrases, and the blocks that hold a notice.

    A missing or empty text has no words and nothing is found; equal rows give equal rows; columns
    other than doc_id and text are ignored. Long texts are scanned whole, block by block. A notice
    that lies in two overlapping blocks is reported for both.
    """
    longest = max((len(alnum_words(t)) for t in [*phrases, *notices]), default=0)
    if longest > block // 2 + 1:
        raise ValueError(f"a template has {longest} words; blocks of {block} hold at most {block // 2 + 1}")
    vocabulary = sorted({w for text in [*phrases, *notices] for w in alnum_words(text)})
    index = TemplateIndex(count_words(docs, vocabulary), threshold, phrases, notices)

    def scan_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, blocks = [], [], []
            for value in batch.column(1):
                words = alnum_words(value.as_py())
                here, around = index.scan(words, block)
                n_words.append(len(words))
                places.append([{"label": label, "word": word} for label, word in here])
                blocks.append([{"label": label, "first_word": word, "containment": c} for label, word, c in around])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                    pa.array(blocks, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))),
                ],
                names=["doc_id", "n_words", "places", "blocks"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan_partition, FOUND)

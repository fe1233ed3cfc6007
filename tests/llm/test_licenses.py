import random
import re

import pytest

from tertulia.llm import licenses
from tertulia.llm.words import alnum_words
from tests.llm.cases import documents, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, threshold=0.8, block=licenses.BLOCK):
    """All places of phrases, and all blocks against all templates."""
    words = words_of(text)
    places = [
        (label, i)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    blocks = []
    for start in range(0, max(len(words), 1), block // 2):
        inside = set(words[start : start + block])
        for notice, label in licenses.NOTICES.items():
            wanted = set(notice.split())
            if len(inside & wanted) >= threshold * len(wanted) and not (wanted & licenses.NAMING) - inside:
                blocks.append((label, start, len(inside & wanted) / len(wanted)))
    return len(words), sorted(places), sorted(blocks)


def random_text(rng):
    parts = [*licenses.PHRASES, *licenses.NOTICES, "some other words of no license at all", "the the of MIT License", "GNU"]
    text = " ".join(rng.choice(parts) if rng.random() < 0.3 else rng.choice("a b the of license under version".split()) for _ in range(rng.randrange(60)))
    kept = [w for w in text.split() if rng.random() < 0.95]
    return rng.choice([" ", "\n", ", "]).join(kept).title()


def test_words():
    for text in ("A-b_c9 É'é x y 中 ½ \x00 ~z", "", "--"):
        assert [w.decode() for w in alnum_words(text)] == words_of(text)


def test_scan_equals_all_against_all(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng)) for i in range(300)] + [(1000 + i, *r[1:]) for i, r in enumerate(odd_rows())]
    found = licenses.scan(documents(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(found) == len(rows)
    for r in found:
        places = sorted((p["label"], p["word"]) for p in r["places"])
        blocks = sorted((b["label"], b["first_word"], b["containment"]) for b in r["blocks"])
        assert (r["n_words"], places, blocks) == by_hand(texts[r["doc_id"]])


def test_order_of_words_does_not_matter():
    """The filters leave out no match whatever the counts are."""
    rng = random.Random(6)
    texts = [alnum_words(random_text(rng)) for _ in range(100)]
    found = set()
    for seed in range(5):
        counts = {w: random.Random(seed).randrange(1000) for text in texts for w in text}
        index = licenses.TemplateIndex(counts, 0.8, licenses.PHRASES, licenses.NOTICES)
        found.add(repr([(sorted(p), sorted(b)) for p, b in map(index.scan, texts)]))
    assert len(found) == 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This is released under the Apache License.", {"apache"}),
        ("released under the GPL license", set()),
        ("under the terms of the GNU General Public License", {"gpl"}),
        ("Released under the MIT licence", {"mit"}),
        ("the terms of the GNU Lesser General Public License", {"gpl", "lgpl"}),
        ("subject to the terms of the public license", set()),
        ("Permission is hereby granted, free of charge, to any person getting a copy", {"mit"}),
    ],
)
def test_a_notice_needs_the_word_that_names_its_license(spark, text, labels):
    found = licenses.scan(documents(spark, [(1, text)])).first()
    assert {x["label"] for x in [*found["places"], *found["blocks"]]} == labels


def test_template_longer_than_half_a_block_is_refused(spark):
    with pytest.raises(ValueError, match="words"):
        licenses.scan(documents(spark, []), block=16)


def test_no_rows(spark):
    assert licenses.scan(documents(spark, [])).count() == 0

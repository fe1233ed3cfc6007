import re
from collections import Counter

import pytest

from tertulia.llm import quality
from tests.llm.cases import PROSE, documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None, "", "a", "a b", "a b c a b c", "x x x x", "a b c d a b c\nq\nq \nq\n\n \n", "é é é é\n#*$ <>|&%", "b a b a b a b a",
    "Only\x1cone\x85word here there", " lead and trail \n" * 3,
]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert quality.measure(text)[:5] == by_hand(text)


def test_repeated_words_with_numbers_beyond_62_bits():
    words = [b"%d" % i for i in range(3000)] * 2
    assert quality.repeated_words(words, width=7) == 6000


def prose(i):
    return " ".join(f"{w}{(i * 7 + k) % 13}" for k, w in enumerate((PROSE * 4).split())) + "."


def junk(i):
    kinds = [
        " ".join(f"{w}***" for w in prose(i).split()),
        prose(i).upper().replace(" ", "!! "),
        prose(i).replace(" ", " | "),
        ("same words again " * 40) + str(i),
    ]
    return kinds[i % 4]


def test_model_tells_junk_from_prose(spark):
    rows = [(i, prose(i) if i % 10 else junk(i // 10)) for i in range(300)]
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, rows)).collect()}
    assert sorted(i for i in judged if not judged[i]) == [i for i in range(300) if i % 10 == 0]
    left = quality.keep_good(documents(spark, rows))
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [i for i in range(300) if i % 10]
    assert left.columns == documents(spark, rows).columns


def test_accuracies_are_estimated():
    """Votes drawn with known accuracies: the estimates come near them."""
    model = quality.fit({"+++": 700, "++0": 200, "--+": 40, "-++": 30, "+--": 30}, 3)
    assert 0.85 < model.good < 0.97
    assert min(model.right_on_good) >= 0.998
    assert model.posterior["+++"] > 0.9 > 0.5 > model.posterior["--+"]


def test_prose_alone_is_kept(spark):
    judged = quality.judge(documents(spark, [(i, prose(i)) for i in range(40)]))
    assert judged.where("kept").count() == 40


def test_odd_rows(spark):
    rows = odd_rows()
    judged = quality.judge(documents(spark, rows)).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in judged) == sorted(
        by_hand(r[1]) for r in rows
    )
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in judged)
    assert not [r for r in judged if r["base_failed"] and r["kept"]]
    assert quality.keep_good(documents(spark, rows)).columns == documents(spark, rows).columns


def test_no_rows(spark):
    assert quality.judge(documents(spark, [])).count() == 0
    assert quality.keep_good(documents(spark, [])).count() == 0

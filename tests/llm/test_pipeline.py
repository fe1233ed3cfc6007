import random

import corpus_pipeline
from tertulia.plans.staging import stage
from tests.llm.cases import PROSE, documents, odd_rows


def corpus():
    """Prose of 240 words, with junk, near copies and personal data in known places."""
    rng = random.Random(1)
    vocabulary = [f"{w.lower()}{c}" for w in PROSE.split() for c in "abcdefghij"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(240)]
        if i % 10 == 3:
            words = rows[-1][1].split(" ")
            words[5] = "changed"
        if i % 10 == 5:
            words[100:100] = ["write", "to", f"person{i}@mail.example.com"]
        if i % 10 == 7:
            words = [f"{w}###" for w in words]
        rows.append((i, " ".join(words), f"s{i % 3}"))
    return rows


def test_stages(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = []
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, "")
        assert out.columns == docs.columns
        docs = stage(out)
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    good = [i for i in range(120) if i % 10 != 7]
    assert kept[0] == good
    assert kept[1] == kept[2] == [i for i in good if i % 10 != 3]
    assert set(kept[3]) <= set(kept[2])
    assert not docs.where("text like '%@%'").count()
    assert docs.where("text like '%[EMAIL]%'").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    tokens = {}
    for p in pieces:
        tokens[p["sequence_id"]] = tokens.get(p["sequence_id"], 0) + p["length"]
    assert max(tokens.values()) <= 1024
    assert {p["doc_id"] for p in pieces} == set(kept[3])


def test_mix_meets_its_targets(spark):
    docs = documents(spark, [r for r in corpus() if r[0] % 10 not in (3, 7)])
    words = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    total = sum(len(r["text"].split()) for r in docs.collect())
    assert abs(sum(words.values()) - 1.5 * total) <= 3 * 512
    assert words["s0"] > words["s1"] > words["s2"]


def test_run(spark, tmp_path):
    documents(spark, corpus() + [(1000 + i, *r[1:]) for i, r in enumerate(odd_rows())]).select(
        "doc_id", "text", "lang", "source", "n_chars"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100


def test_odd_rows_and_none_through_every_stage(spark):
    for rows in (odd_rows(), []):
        for _, function in corpus_pipeline.STAGES:
            out = function(spark, documents(spark, rows), "")
            assert out.count() >= 0

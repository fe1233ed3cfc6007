import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tertulia import load_tables
from tertulia.functions.text import WHITE_SPACE, parse_date, strip
from tertulia.operators import emails
from tertulia.operators.emails import (
    known_emails,
    parse_email_lines,
    parse_reply_all,
    resolve_members,
    unknown_emails,
)
from tertulia.plans.staging import stage


def batches(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "id_lote bigint, texto string")


def test_lines_are_cleaned_and_distinct(spark, rows):
    found = parse_email_lines(batches(spark, "A@x.com\r\n b@x.com \n\n\ta@X.com\n", None, "", " \r\n"))
    assert rows(found) == [(1, "a@x.com"), (1, "b@x.com")]


def test_carriage_return_inside_an_address(spark, rows):
    texts = batches(spark, "a@x\r.com\r\n")
    assert rows(parse_email_lines(texts)) == [(1, "a@x.com")]
    assert rows(parse_email_lines(texts, drop_cr=False)) == [(1, "a@x\r.com")]


def test_no_break_space_is_trimmed(spark, rows):
    assert rows(parse_email_lines(batches(spark, "\xa0a@x.com\xa0"))) == [(1, "a@x.com")]


def test_same_address_in_two_batches(spark, rows):
    assert rows(parse_email_lines(batches(spark, "a@x", "a@x"))) == [(1, "a@x"), (2, "a@x")]


def test_reply_all(spark, rows):
    texts = batches(spark, "Ana Paz <Ana@x.com>; Bo <bo@x.com>;\n raw@x.com ;")
    found = [(1, "ana@x.com"), (1, "bo@x.com"), (1, "raw@x.com")]
    assert rows(parse_reply_all(texts)) == found
    assert rows(parse_reply_all(texts, keep_blank=True)) == [(1, ""), *found]


ADDRESS = st.from_regex(r"[a-z]{1,4}(\.[a-z]{1,3})?@[a-z]{1,3}\.mx", fullmatch=True)
PAD = st.text(alphabet=" \t\r\xa0\x1f\u3000", max_size=3)


@st.composite
def pasted(draw):
    """An address in the noise people paste it with: padding, capitals, blank lines around it."""
    address = draw(ADDRESS)
    shown = "".join(c.upper() if draw(st.booleans()) else c for c in address)
    return address, shown, draw(PAD), draw(PAD), draw(st.sampled_from(["plain", "named", "blank"]))


def as_line(entry):
    _, shown, before, after, form = entry
    return before + shown + after + ("\n" + before if form == "blank" else "")


def as_recipient(entry):
    _, shown, before, after, form = entry
    return {"plain": f"{before}{shown}{after}", "named": f"{before}A. Person <{shown}>{after}", "blank": f"\n{shown};{after}"}[form]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(pasted(), max_size=5), min_size=30, max_size=30), st.integers(0, 4))
def test_known_addresses_come_back_from_noise(spark, texts, at):
    want = {(i, e[0]) for i, text in enumerate(texts, 1) for e in text}
    blank = {(i, "") for i, text in enumerate(texts, 1) if not text or any(e[4] == "blank" for e in text)}
    lines = batches(spark, *["\n".join(map(as_line, text)) for text in texts])
    broken = batches(spark, *["\n".join(as_line((e[0], e[1][:at] + "\r" + e[1][at:], *e[2:])) for e in text) for text in texts])
    recipients = batches(spark, *[";".join(map(as_recipient, text)) for text in texts])
    for found, expected in (
        (parse_email_lines(lines), want),
        (parse_email_lines(lines, drop_cr=False), want),
        (parse_email_lines(broken), want),
        (parse_reply_all(recipients), want),
        (parse_reply_all(recipients, keep_blank=True), want | blank),
    ):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got))
        assert set(got) == expected


def test_white_space_is_what_python_strips(spark):
    assert {c for c in map(chr, range(0x110000)) if not c.strip()} == set(WHITE_SPACE)
    df = spark.createDataFrame([(f"{WHITE_SPACE}a{WHITE_SPACE}b{WHITE_SPACE}",)], "x string")
    assert df.select(strip(F.col("x"))).first()[0] == f"a{WHITE_SPACE}b"


@pytest.fixture
def members(make):
    return make(comunidad=[(3, None, None, "a@x"), (2, None, None, "a@x"), (4, None, None, "B@x ")])


def test_matching_is_exact_unless_normalized(spark, rows, members):
    emails = spark.createDataFrame([("a@x",), ("b@x",), ("c@x",)], "correo string")
    assert rows(known_emails(members, emails)) == [("a@x",)]
    assert rows(unknown_emails(members, emails)) == [("b@x",), ("c@x",)]
    assert rows(known_emails(members, emails, normalize=True)) == [("a@x",), ("b@x",)]
    assert rows(unknown_emails(members, emails, normalize=True)) == [("c@x",)]


def test_members_who_share_an_address(spark, rows, members):
    emails = spark.createDataFrame([("a@x",), ("c@x",)], "correo string")
    assert rows(resolve_members(members, emails)) == [("a@x", 2)]
    assert rows(resolve_members(members, emails, first_only=False)) == [("a@x", 2), ("a@x", 3)]


# Very long texts


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10_000])
def test_pieces_hold_the_same_entries(spark, size):
    """However a text is cut, its entries are those of the whole text, in order."""
    texts = [None, "", ";", ";;", "a", "a;", ";a", "a;b", "ana@x; bo@x;;cy@x;", "x" * 40, "x" * 9 + ";" + "ñ😀" * 9, ";" * 11, "a;" * 20]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, texto string")
    cut = df.select("n", F.posexplode(emails.in_pieces("texto", ";", size, -1)).alias("nth", "piece"))
    got = {}
    for r in cut.orderBy("n", "nth").collect():
        got.setdefault(r["n"], []).extend(r["piece"].split(";"))
    assert got == {i: x.split(";") for i, x in enumerate(texts) if x is not None}
    assert cut.where(F.size(F.split("piece", ";")) > size).isEmpty()


def test_a_text_of_100_mb_is_parsed_by_several_tasks(spark):
    """One list of four million addresses, of which a quarter repeat."""
    line = F.concat(F.lit("Persona <p"), (F.col("id") % 3_000_000).cast("string"), F.lit("@example.com>"))
    parts = spark.range(0, 4_000_000, 1, 4).select(line.alias("x"))
    whole = parts.agg(F.array_join(F.collect_list("x"), "; ").alias("texto")).select(F.lit(1).alias("id_lote"), "texto")
    text = stage(whole)
    assert text.select(F.length("texto")).first()[0] > 100_000_000
    pieces = text.select("id_lote", F.posexplode(emails.in_pieces("texto", ";")).alias("nth", "piece")).repartition("id_lote", "nth")
    sizes = [r[1] for r in pieces.groupBy(F.spark_partition_id()).agg(F.sum(F.length("piece"))).collect()]
    assert len(sizes) > 1 and max(sizes) < 60_000_000
    found = emails.parse_reply_all(text, spread=True)
    assert found.agg(F.count("correo"), F.countDistinct("correo")).first()[:] == (3_000_000, 3_000_000)


# Dates


def test_dates_in_texts(spark):
    said = {
        "2024-03-05": (2024, 3, 5), "2024/03/05": (2024, 3, 5), "20240305": (2024, 3, 5), " 2024-03-05 10:20:30 ": (2024, 3, 5),
        "2024-03-05T10:20:30": (2024, 3, 5), "3/5/2024": (2024, 3, 5), "25/3/2024": (2024, 3, 25), "25.03.2024": (2024, 3, 25),
        "5 Mar 2024": (2024, 3, 5), "March 5, 2024": (2024, 3, 5), "Mar 5, 2024": (2024, 3, 5),
        "2024-02-30": None, "31/31/2024": None, "pronto": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in said], "texto string").withColumn("fecha", parse_date("texto"))
    assert {r["texto"]: r["fecha"] for r in df.collect()} == {k: v and dt.date(*v) for k, v in said.items()}


def test_a_warehouse_with_dates_as_text(spark, tmp_path):
    spark.sql(f"CREATE DATABASE textos LOCATION '{tmp_path}/textos'")
    try:
        spark.createDataFrame([("7", "1", "5/3/2024")], "ID_CLASE string, ID_CURSO string, FECHA string").write.saveAsTable("textos.clase")
        got = load_tables(spark, "textos", fmt="table").clase.first()
        assert (got.id_clase, str(got.fecha)) == (7, "2024-05-03")
    finally:
        spark.sql("DROP DATABASE textos CASCADE")

"""Stored layouts: which files a change touches, and what plans no longer shuffle or read."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from samples import stored
from samples.views import Samples
from tertulia.operators import deletes, reports, rosters, updates
from tertulia.plans.bitmaps import bitmaps, count_ids, merge, words
from tertulia.sources import Change, append_rows, read_parts, rewrite_parts, write_by_month, write_parts
from tests.test_plans import NO_BROADCAST, SF, plan_of, settings

PARTS = 16


@pytest.fixture(scope="module")
def samples(spark):
    return Samples(spark, SF)


def files(path) -> dict[str, int]:
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def parts_of(names) -> set[str]:
    return {n.split("/")[0] for n in names}


# Parts


def test_setting_a_status_rewrites_its_part(spark, rows, samples, tmp_path):
    path = f"{tmp_path}/registrados_curso"
    write_parts(samples.tables.registrados_curso, path, ["id_curso", "id_usuario"], PARTS)
    t = samples.tables.with_tables(registrados_curso=read_parts(spark, path))
    one = t.registrados_curso.orderBy("id_curso", "id_usuario").first()
    before, old = files(path), rows(read_parts(spark, path))
    changes = spark.createDataFrame([(one.id_curso, one.id_usuario, not one.status, True)], "id_curso long, id_usuario long, status boolean, curso_aprobado boolean")
    touched = rewrite_parts(spark, path, updates.set_registrant_status(t, changes), "registrados_curso")
    after = files(path)
    assert len(touched) == 1 and len(parts_of(before)) == PARTS
    assert parts_of(after.keys() - before.keys()) == parts_of(before.keys() - after.keys()) == {f"parte={touched[0]}"}
    assert {n: after[n] for n in before.keys() & after.keys()} == {n: before[n] for n in before.keys() & after.keys()}
    new = {tuple(one): (one.id_curso, one.id_usuario, not one.status, one.solicitud_aprobada, True)}
    assert rows(read_parts(spark, path)) == sorted((new.get(r, r) for r in old), key=repr)


def test_deleting_members_touches_their_parts(spark, rows, samples, tmp_path):
    path = f"{tmp_path}/comunidad"
    write_parts(samples.tables.comunidad, path, ["id_usuario"], PARTS)
    t = samples.tables.with_tables(comunidad=read_parts(spark, path))
    ids = spark.createDataFrame([(1000001,), (1000002,), (1,)], "id_usuario long")  # the last takes part in something
    before, old = files(path), rows(t.comunidad)
    touched = rewrite_parts(spark, path, deletes.delete_members(t, ids), "comunidad")
    changed = parts_of(files(path).keys() ^ before.keys())
    assert 1 <= len(touched) <= 2 and changed == {f"parte={p}" for p in touched}
    assert rows(read_parts(spark, path)) == [r for r in old if r[0] not in (1000001, 1000002)]


def test_a_part_that_loses_all_rows_goes(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k long, v string")
    write_parts(table, path, ["k"], 64)
    gone = read_parts(spark, path).where("k < 3")
    touched = rewrite_parts(spark, path, Change({}, removed={"t": gone}), "t")
    assert rows(read_parts(spark, path)) == [(i, f"v{i}") for i in range(3, 6)]
    assert len(parts_of(files(path))) <= 3 and len(touched) <= 3


def test_repeats_nulls_and_new_rows(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (2, "c")], "k long, v string")
    write_parts(table, path, ["k"], 4)
    change = Change(
        {},
        added={"t": spark.createDataFrame([("z", 9), ("y", 9)], "v string, k long")},
        changed={"t": spark.createDataFrame([(1, "A"), (1, "B")], "k long, v string")},
    )
    rewrite_parts(spark, path, change, "t")
    assert rows(read_parts(spark, path)) == sorted([(1, "A"), (1, "B"), (None, "n"), (2, "c"), (9, "y"), (9, "z")], key=repr)
    # The same change again, as after a driver was lost: changed rows stay, added ones would come twice.
    rewrite_parts(spark, path, Change({}, changed=change.changed), "t")
    assert read_parts(spark, path).count() == 6
    assert rewrite_parts(spark, path, Change({}), "t") == []


# Buckets


def exchanges_over(plan: str, table: str) -> int:
    """Exchanges between the scan of a table and the root."""
    lines = plan.splitlines()
    scan = max(i for i, line in enumerate(lines) if table in line and "Scan" in line)
    depth, found = len(re.match(r"[\s:+\-]*", lines[scan]).group()), 0
    for line in reversed(lines[:scan]):
        at = len(re.match(r"[\s:+\-]*", line).group())
        if at < depth:
            depth = at
            found += "Exchange" in line
    return found


def test_rosters_join_buckets_without_a_shuffle(spark, rows, samples):
    t = stored.bucketed(samples, "comunidad", "invitacion_sesion")
    with settings(spark, **NO_BROADCAST):
        df = rosters.session_invitees(t)
        assert "Exchange" not in plan_of(df)
        assert "Exchange" in plan_of(rosters.session_invitees(samples.tables))
    assert rows(df) == rows(rosters.session_invitees(samples.tables))


def test_dependents_are_counted_without_moving_rows(spark, rows, samples):
    """Every table is counted where it lies: what moves, if anything, is counts."""
    names = ("comunidad", "invitacion_curso", "registrados_curso", "invitacion_sesion", "asistencia_sesion")
    t = stored.bucketed(samples, *names)
    with settings(spark, **NO_BROADCAST):
        df = reports.member_dependents_stored(t)
        assert "Exchange" not in plan_of(df)
    assert rows(df) == rows(reports.member_dependents(samples.tables))


# Months


def test_a_period_reads_its_months(spark, rows, samples, tmp_path):
    path = f"{tmp_path}/asistencia"
    write_by_month(samples.tables.asistencia_sesion, samples.tables.sesion, "id_sesion", "fecha_sesion", path)
    by_month = spark.read.parquet(path)
    assert by_month.count() == samples.tables.asistencia_sesion.count()
    sessions = f"{tmp_path}/sesion"
    append_rows(samples.tables.sesion, sessions)
    t = samples.tables.with_tables(sesion=spark.read.parquet(sessions))
    df = reports.period_attendance(t, *stored.PERIOD, by_month=by_month)
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan_of(df))
    assert rows(df) == rows(reports.period_attendance(t, *stored.PERIOD))
    read = df._jdf.queryExecution().executedPlan()
    df.collect()
    assert "dynamicpruning" in read.toString()


def test_events_without_a_day(spark, rows, make, tmp_path):
    t = make(
        sesion=[(1, "S", dt.date(2024, 3, 31), ""), (2, "T", None, ""), (3, "U", dt.date(2024, 4, 1), ""), (4, "V", dt.date(2024, 3, 1), "")],
        asistencia_sesion=[(1, 7), (1, 7), (1, 8), (2, 7), (9, 7), (3, None), (None, 7)],
    )
    path = f"{tmp_path}/a"
    write_by_month(t.asistencia_sesion, t.sesion, "id_sesion", "fecha_sesion", path)
    back = spark.read.parquet(path)
    assert rows(back.select("id_sesion", "id_usuario")) == rows(t.asistencia_sesion)
    period = dt.date(2024, 3, 1), dt.date(2024, 4, 30)
    want = [(1, "S", dt.date(2024, 3, 31), 2), (3, "U", dt.date(2024, 4, 1), 0), (4, "V", dt.date(2024, 3, 1), 0)]
    assert rows(reports.period_attendance(t, *period, by_month=back)) == rows(reports.period_attendance(t, *period)) == want


# Bitmaps


def test_attendance_moves_as_bitmaps(spark, samples, tmp_path):
    for name in ("clase", "asistencia_clase"):
        append_rows(getattr(samples.tables, name), f"{tmp_path}/{name}")
    t = samples.tables.with_tables(**{n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("clase", "asistencia_clase")})
    plan = plan_of(reports.class_attendance(t, by_bitmap=True))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # One shuffle by date and bucket, whose rows are bitmaps, and one of a count per date and bucket.
    assert sum("_bucket" in line for line in moved) == 1 and len(moved) <= 2
    assert "partial_bitmap_construct_agg" in plan and "Expand" not in plan


def test_attendees_of_sessions_move_as_bitmaps(spark, samples, tmp_path):
    append_rows(samples.tables.asistencia_sesion, f"{tmp_path}/a")
    t = samples.tables.with_tables(asistencia_sesion=spark.read.parquet(f"{tmp_path}/a"))
    plan = plan_of(reports.session_attendance_pct(t))
    assert "partial_bitmap_construct_agg" in plan
    # Sessions and buckets of bitmaps are dealt out; the one shuffle by member is that of the members' own count.
    by_member = [line for line in plan.splitlines() if "Exchange hashpartitioning(id_usuario" in line]
    assert re.search(r"Exchange hashpartitioning\(id_sesion#\d+L, _bucket", plan) and len(by_member) <= 1


def test_bitmaps_count_what_distinct_counts(spark, rows):
    far = [0, 1, -1, 32767, 32768, 32769, 2**40, -(2**40), None]
    pairs = [(k, far[(i * k) % len(far)]) for k in range(1, 6) for i in range(20)] + [(None, 5), (None, 5), (9, None)]
    df = spark.createDataFrame(pairs, "k long, id long")
    want = rows(df.groupBy("k").agg(F.countDistinct("id")))
    assert rows(count_ids(bitmaps(df, ["k"], "id"), ["k"], "n")) == want
    halves = df.withColumn("half", F.col("id") % 2)
    fine = bitmaps(halves, ["k", "half"], "id")
    assert rows(count_ids(merge(fine, ["k"]), ["k"], "n")) == want


def test_stored_bitmaps_take_new_attendance(spark, rows, make):
    day = dt.date(2024, 1, 1)
    t = make(clase=[(1, 1, day), (2, 1, day), (3, 1, None), (4, 2, day)], asistencia_clase=[(1, 5), (1, 5), (2, 5), (2, 6), (3, 5), (7, 5)])
    old = reports.attendance_bitmaps(t)
    assert rows(reports.class_attendance_of(t, old)) == rows(reports.class_attendance(t))
    more = make(asistencia_clase=[(4, 8), (1, 6)])
    both = merge(old.unionByName(reports.attendance_bitmaps(more)), ["id_clase"])
    now = t.with_tables(asistencia_clase=t.asistencia_clase.unionByName(more.asistencia_clase))
    assert rows(reports.class_attendance_of(now, both)) == rows(reports.class_attendance(now)) == rows(reports.class_attendance(now, by_bitmap=True))


def test_no_bitmap_of_4_kb_is_shuffled_or_sorted(samples, spark, tmp_path):
    """With a few ids in each of many buckets, bitmaps would take hundreds of times the memory of the pairs."""
    for name in ("asistencia_sesion", "clase", "asistencia_clase"):
        append_rows(getattr(samples.tables, name), f"{tmp_path}/{name}")
    t = samples.tables.with_tables(**{n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("asistencia_sesion", "clase", "asistencia_clase")})
    for df in (reports.session_attendance_pct(t), reports.class_attendance(t, by_bitmap=True)):
        lines = [line.strip(" :+-") for line in plan_of(df).splitlines()]
        below = [lines[i + 1] for i, line in enumerate(lines) if re.match(r"(Sort|Exchange hashpartitioning) ?[\[(]", line)]
        assert below and not any("partial_bitmap_construct_agg" in line for line in below)
    stored = reports.attendance_bitmaps(t)
    assert stored.schema["_bits"].dataType.simpleString() == "bigint"
    assert "bitmap_or_agg" not in plan_of(merge(stored, ["id_clase"]))


def test_words_count_what_distinct_counts(spark, rows):
    far = [0, 1, -1, 63, 64, -64, -65, 2**40, -(2**40), 2**63 - 1, -(2**63), None]
    pairs = [(k, far[(i * k) % len(far)]) for k in range(1, 6) for i in range(30)] + [(None, 5), (None, 5), (9, None)]
    df = spark.createDataFrame(pairs, "k long, id long").withColumn("half", F.col("id") % 2)
    want = rows(df.groupBy("k").agg(F.countDistinct("id")))
    assert rows(count_ids(words(df, ["k"], "id"), ["k"], "n")) == want
    assert rows(count_ids(merge(words(df, ["k", "half"], "id"), ["k"]), ["k"], "n")) == want

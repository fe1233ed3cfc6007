"""Counts kept up to date, edited grids, and references that must exist."""

import random

import pytest
from pyspark.sql import functions as F

from samples.views import Samples
from tertulia.operators import adds, deletes, registrations, reports, updates
from tertulia.operators.grids import grid_changes
from tertulia.plans.staging import stage
from tertulia.plans.upkeep import COURSE_PAIRS, RUN_RESULTS, SESSION_PAIRS
from tertulia.sources import Change, append_rows, read_parts, rewrite_parts, write_parts
from tests.test_plans import NO_BROADCAST, SF, plan_of, settings


@pytest.fixture
def t(make):
    draw = random.Random(4)
    pairs = lambda n, keys: [(draw.randint(1, keys), draw.randint(1, 12)) for _ in range(n)]
    flags = lambda: draw.choice([True, False, None])
    return make(
        comunidad=[(i, "N", "A", f"m{i}@x", True, None, None, None, None) for i in range(1, 11)],
        sesion=[(i, f"S{i}", None, "") for i in range(1, 6)],
        catalogo_cursos=[(1, "SQL"), (2, "Spark")],
        curso=[(i, 1 + i % 2, None, None, "P", True, "c@x") for i in range(1, 7)],
        invitacion_sesion=pairs(40, 5),
        asistencia_sesion=pairs(30, 5),
        invitacion_curso=pairs(40, 6),
        registrados_curso=[(*p, flags(), flags(), flags()) for p in pairs(40, 6)],
    )


def texts(spark, key, *rows):
    return spark.createDataFrame(list(rows), f"{key} long, texto string")


def some_changes(spark, t):
    """Adds, updates and deletes in turn, each made from the state before it."""
    yield registrations.register_session_attendance, texts(spark, "id_sesion", (1, "m1@x\nm2@x"), (4, "m9@x\nm10@x"))
    yield registrations.register_session_invitees, texts(spark, "id_sesion", (2, "m1@x\nm2@x\nm3@x"))
    yield registrations.register_course_registrants, texts(spark, "id_curso", (1, "m1@x\nm2@x\nm7@x"), (6, "m9@x"))
    yield registrations.register_course_invitees, texts(spark, "id_curso", (3, "m4@x\nm5@x"))
    flags = spark.createDataFrame([(1, 1, True, True), (2, 2, False, None), (6, 9, None, True), (1, 7, True, True)], "id_curso long, id_usuario long, status boolean, curso_aprobado boolean")
    yield updates.set_registrant_status, flags
    yield adds.add_members_minimal, spark.createDataFrame([("A", "B", "m99@x")], "nombre string, apellido string, correo string")
    yield deletes.delete_members, spark.createDataFrame([(i,) for i in range(1, 13)], "id_usuario long")
    yield deletes.delete_sessions, spark.createDataFrame([(i,) for i in range(1, 6)], "id_sesion long")


def test_kept_counts_equal_a_recount(spark, rows, t):
    kept = {tally: tally.count(t) for tally in (SESSION_PAIRS, COURSE_PAIRS, RUN_RESULTS)}
    for function, given in some_changes(spark, t):
        change = function(t, given)
        t = t.apply(change)
        kept = {tally: stage(tally.bring_up(stored, change)) for tally, stored in kept.items()}
        for tally, stored in kept.items():
            assert rows(stored) == rows(tally.count(t).select(*stored.columns))
    assert rows(reports.session_funnel(t, pairs=kept[SESSION_PAIRS])) == rows(reports.session_funnel(t))
    assert rows(reports.session_funnel(t, 2, kept[SESSION_PAIRS])) == rows(reports.session_funnel(t, 2))
    assert rows(reports.course_funnel(t, pairs=kept[COURSE_PAIRS])) == rows(reports.course_funnel(t))
    assert rows(reports.completion_rates(t, kept[RUN_RESULTS])) == rows(reports.completion_rates(t))


def test_removed_rows_are_taken_off(spark, rows, t):
    gone = t.asistencia_sesion.where("id_sesion = 2")
    change = Change({"asistencia_sesion": t.asistencia_sesion.where("id_sesion <> 2")}, removed={"asistencia_sesion": gone})
    kept = SESSION_PAIRS.bring_up(SESSION_PAIRS.count(t), change)
    assert rows(kept) == rows(SESSION_PAIRS.count(t.apply(change)))
    assert SESSION_PAIRS.delta(Change({}, added={"clase": t.clase})) is None


def test_counts_are_stored_in_parts(spark, rows, t, tmp_path):
    path = f"{tmp_path}/pairs"
    write_parts(SESSION_PAIRS.count(t), path, list(SESSION_PAIRS.keys), 64)
    change = registrations.register_session_attendance(t, texts(spark, "id_sesion", (1, "m1@x\nm2@x")))
    stored = read_parts(spark, path)
    touched = rewrite_parts(spark, path, SESSION_PAIRS.moved(stored, change, "pairs"), "pairs")
    assert 0 < len(touched) <= 2
    assert rows(read_parts(spark, path)) == rows(SESSION_PAIRS.count(t.apply(change)))


def test_the_facts_are_read_through_the_delta_alone(spark, tmp_path):
    samples = Samples(spark, SF)
    names = ("asistencia_sesion", "invitacion_sesion", "comunidad", "sesion")
    for name in names:
        append_rows(getattr(samples.tables, name), f"{tmp_path}/{name}")
    t = samples.tables.with_tables(**{n: spark.read.parquet(f"{tmp_path}/{n}") for n in names})
    pairs = stage(SESSION_PAIRS.count(t))
    change = registrations.register_session_attendance(t, texts(spark, "id_sesion", (1, "customer.000000001@example.com")))
    kept = SESSION_PAIRS.bring_up(pairs, Change({}, added={n: stage(df) for n, df in change.added.items()}))
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(reports.session_funnel(t, pairs=kept))
    read = "".join(reports.session_funnel(t, pairs=kept).inputFiles())
    assert "asistencia_sesion" not in read and "Exchange" in plan
    assert "invitacion_sesion" in "".join(reports.session_funnel(t).inputFiles())
    assert "invitacion_sesion" not in read


# Grids

GRID = "k long, a string, b boolean, c int"


def compared(spark, rows, before, after, keys=("k",), shape=GRID):
    edits = grid_changes(spark.createDataFrame(before, GRID), spark.createDataFrame(after, shape), keys)
    return {n: rows(getattr(edits, n)) for n in ("changed", "full", "added", "removed", "unclear")}


def test_only_changed_cells_come_out(spark, rows):
    before = [(1, "x", True, 1), (2, "y", None, 2), (3, None, False, 3), (4, "z", True, None), (5, "same", None, None)]
    after = [(5, "same", None, None), (4, None, True, 7), (2, "y", False, 2), (3, "", False, 3), (6, "new", None, 1)]
    got = compared(spark, rows, before, after)
    assert got["changed"] == [(2, None, False, None, ["b"]), (3, "", None, None, ["a"]), (4, None, None, 7, ["a", "c"])]
    assert got["full"] == [(2, "y", False, 2), (3, "", False, 3), (4, None, True, 7)]
    assert (got["added"], got["removed"], got["unclear"]) == ([(6, "new", None, 1)], [(1, "x", True, 1)], [])


def test_repeats_and_missing_keys(spark, rows):
    before = [(1, "x", True, 1)] * 3 + [(2, "y", True, 1), (2, "z", True, 1), (None, "n", True, 1), (3, "q", None, None)]
    after = [(1, "x", True, 1)] * 3 + [(2, "y", True, 1), (2, "w", True, 1), (None, "m", True, 1), (3, "q", None, None), (3, "q", None, None)]
    got = compared(spark, rows, before, after)
    # Of two rows of key 2 one is as it was, so the other is the one that changed; a key that is missing tells nothing.
    assert got["changed"] == [(2, "w", None, None, ["a"])]
    assert got["added"] == [(3, "q", None, None)] and got["removed"] == []
    assert got["unclear"] == sorted([(None, "n", True, 1, -1), (None, "m", True, 1, 1)], key=repr)
    twice = compared(spark, rows, [(1, "x", True, 1), (1, "y", True, 1)], [(1, "v", True, 1), (1, "w", True, 1)])
    assert len(twice["unclear"]) == 4 and not twice["changed"]


def test_columns_that_were_not_shown(spark, rows):
    got = compared(spark, rows, [(1, "x", True, 1), (2, "y", True, 2)], [(2, "y"), (1, "X")], shape="k int, a string")
    assert got["changed"] == [(1, "X", ["a"])] and got["full"] == [(1, "X")]


def test_an_unchanged_grid_gives_nothing(spark, rows):
    same = [(1, "x", True, 1), (1, "x", True, 1), (None, None, None, None)]
    assert not any(compared(spark, rows, same, same[::-1]).values())


def test_a_change_from_a_grid(spark, rows, t):
    """The grid of one run, with one flag turned, changes that row alone."""
    shown = t.registrados_curso.where("id_curso = 2").dropDuplicates(["id_usuario"])
    who = shown.orderBy("id_usuario").first().id_usuario
    back = shown.withColumn("status", F.when(F.col("id_usuario") == who, ~F.coalesce("status", F.lit(False))).otherwise(F.col("status")))
    edits = grid_changes(shown, back, ["id_curso", "id_usuario"])
    change = updates.set_registrant_status(t, edits.full.select("id_curso", "id_usuario", "status", "curso_aprobado"))
    assert {tuple(r)[:2] for r in change.changed["registrados_curso"].collect()} == {(2, who)}


# References


@pytest.mark.parametrize(
    "function, key, table",
    [
        (registrations.register_session_invitees, "id_sesion", "invitacion_sesion"),
        (registrations.register_session_attendance, "id_sesion", "asistencia_sesion"),
        (registrations.register_course_invitees, "id_curso", "invitacion_curso"),
        (registrations.register_course_registrants, "id_curso", "registrados_curso"),
        (registrations.register_class_attendance, "id_clase", "asistencia_clase"),
    ],
)
def test_unknown_ids_are_rejected(spark, rows, make, function, key, table):
    t = make(
        comunidad=[(1, "N", "A", "a@x", True, None, None, None, None)],
        sesion=[(1, "S", None, "")], curso=[(1, 1, None, None, "P", True, "c@x")], clase=[(1, 1, None)],
    )
    batch = texts(spark, key, (1, "a@x"), (987654321, "a@x\nb@x"), (None, "a@x"))
    change = function(t, batch)
    assert [r[:2] for r in rows(change.added[table])] == [(1, 1)]
    assert rows(change.rejected) == sorted([(987654321, "a@x"), (987654321, "b@x"), (None, "a@x")], key=repr)
    assert len(rows(function(t, batch, must_exist=False).added[table])) >= 2


def test_classes_of_unknown_runs_are_rejected(spark, rows, make):
    t = make(curso=[(1, 1, None, None, "P", True, "c@x")], clase=[(5, 1, None)])
    new = spark.createDataFrame([(1, "2024-01-02"), (987654321, "2024-01-02"), (1, None), (None, "2024-01-03")], "id_curso long, fecha string").withColumn("fecha", F.col("fecha").cast("date"))
    change = adds.add_classes(t, new)
    assert [r[:2] for r in rows(change.added["clase"])] == [(6, 1)]
    assert [r[0] for r in rows(change.rejected)] == [1, 987654321, None]


def test_a_small_dimension_does_not_move_the_batch(spark, tmp_path):
    samples = Samples(spark, SF)
    for name in ("clase", "curso"):
        append_rows(getattr(samples.tables, name), f"{tmp_path}/{name}")
    t = samples.tables.with_tables(**{n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("clase", "curso")})
    new = f"{tmp_path}/nuevas"
    samples.view("nuevas_clases").write.parquet(new)
    plan = plan_of(adds.add_classes(t, spark.read.parquet(new)).rejected)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan

"""Queries that write the sample tables in some layout, change what is stored, and read it back.

Everything goes to new folders below the one for staging tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samples.views import Samples
from tertulia import SCHEMAS, load_tables
from tertulia.operators import adds, deletes, registrations, reports, rosters, updates
from tertulia.operators.grids import Edits, grid_changes
from tertulia.plans.staging import new_folder, stage
from tertulia.plans.upkeep import COURSE_PAIRS, RUN_RESULTS, SESSION_PAIRS
from tertulia.sources import (
    Change,
    Tables,
    read_parts,
    rewrite_parts,
    store_batches,
    write_buckets,
    write_by_month,
    write_change,
    write_parts,
    write_snapshot,
)

PERIOD = dt.date(2024, 3, 1), dt.date(2024, 5, 31)
PARTS, BUCKETS = 32, 8


def table_sizes(s: Samples) -> DataFrame:
    """Rows of every table, by SQL over views of stored tables."""
    folder = new_folder(s.spark)
    for name in SCHEMAS:
        write_snapshot(getattr(s.tables, name), f"{folder}/{name}")
    load_tables(s.spark, folder).as_views("guardada_")
    return s.spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS tabla, count(*) AS filas FROM guardada_{n}" for n in SCHEMAS))


# Parts by key


def _in_parts(s: Samples, table: str, *keys: str) -> tuple[str, Tables]:
    path = f"{new_folder(s.spark)}/{table}"
    write_parts(getattr(s.tables, table), path, keys, PARTS)
    return path, s.tables.with_tables(**{table: read_parts(s.spark, path)})


def _rewritten(s: Samples, path: str, change: Change, table: str) -> DataFrame:
    rewrite_parts(s.spark, path, change, table)
    return read_parts(s.spark, path)


def rewritten_status(s: Samples) -> DataFrame:
    path, t = _in_parts(s, "registrados_curso", "id_curso", "id_usuario")
    return _rewritten(s, path, updates.set_registrant_status(t, s.view("cambios_registro")), "registrados_curso")


def rewritten_members(s: Samples) -> DataFrame:
    path, t = _in_parts(s, "comunidad", "id_usuario")
    return _rewritten(s, path, deletes.delete_members(t, t.comunidad.select("id_usuario")), "comunidad")


def rewritten_links(s: Samples) -> DataFrame:
    path, t = _in_parts(s, "tiene_sesion", "id_curso")
    return _rewritten(s, path, updates.replace_course_sessions(t, s.view("enlaces_curso")), "tiene_sesion")


# Buckets and months


def bucketed(s: Samples, *names: str) -> Tables:
    """The tables in buckets by member, as tables of the catalog."""
    folder, mark = new_folder(s.spark), uuid.uuid4().hex
    for name in names:
        write_buckets(getattr(s.tables, name), f"{name}_{mark}", ["id_usuario"], BUCKETS, f"{folder}/{name}")
    return s.tables.with_tables(**{name: s.spark.table(f"{name}_{mark}") for name in names})


def bucketed_invitees(s: Samples) -> DataFrame:
    return rosters.session_invitees(bucketed(s, "comunidad", "invitacion_sesion"))


def bucketed_dependents(s: Samples) -> DataFrame:
    names = ("comunidad", "invitacion_curso", "registrados_curso", "invitacion_sesion", "asistencia_sesion")
    return reports.member_dependents_stored(bucketed(s, *names))


def attendance_by_month(s: Samples) -> DataFrame:
    path = f"{new_folder(s.spark)}/asistencia"
    write_by_month(s.tables.asistencia_sesion, s.tables.sesion, "id_sesion", "fecha_sesion", path)
    return reports.period_attendance(s.tables, *PERIOD, by_month=s.spark.read.parquet(path))


# Stored counts


def attendance_from_bitmaps(s: Samples) -> DataFrame:
    return reports.class_attendance_of(s.tables, stage(reports.attendance_bitmaps(s.tables)))


def kept_session_funnel(s: Samples) -> DataFrame:
    """After new attendance and invitations: the stored pairs and what the changes add, no fact read again."""
    t, pairs = s.tables, stage(SESSION_PAIRS.count(s.tables))
    batches = s.view("correos_lineas").selectExpr("id_lote", "id_lote AS id_sesion", "texto")
    for register in (registrations.register_session_attendance, registrations.register_session_invitees):
        change = register(t, batches)
        t, pairs = t.apply(change), stage(SESSION_PAIRS.bring_up(pairs, change))
    return reports.session_funnel(t, pairs=pairs)


def kept_course_funnel(s: Samples) -> DataFrame:
    """After registrations, and after members whom nothing refers to have been deleted."""
    t, pairs = s.tables, stage(COURSE_PAIRS.count(s.tables))
    batches = s.view("correos_lineas").selectExpr("id_lote", "id_lote AS id_curso", "texto")
    change = registrations.register_course_registrants(t, batches)
    t, pairs = t.apply(change), stage(COURSE_PAIRS.bring_up(pairs, change))
    change = deletes.delete_members(t, t.comunidad.select("id_usuario"))
    return reports.course_funnel(t.apply(change), pairs=COURSE_PAIRS.bring_up(pairs, change))


def kept_completion_rates(s: Samples) -> DataFrame:
    """After completions have been set: a changed row counts as it is now, less as it was."""
    change = updates.set_registrant_status(s.tables, s.view("cambios_registro"))
    results = RUN_RESULTS.bring_up(stage(RUN_RESULTS.count(s.tables)), change)
    return reports.completion_rates(s.tables.apply(change), results)


# Grids


def _edited(s: Samples) -> Edits:
    """The grid of registrations, with some flags turned or emptied, rows removed, and rows added twice."""
    shown = s.tables.registrados_curso
    n = F.col("id_curso") + F.col("id_usuario")
    back = shown.where(n % 17 != 0).select(
        "id_curso",
        "id_usuario",
        F.when(n % 11 == 0, ~F.coalesce("status", F.lit(False))).otherwise(F.col("status")).alias("status"),
        F.when(n % 13 != 0, F.col("curso_aprobado")).alias("curso_aprobado"),
    )
    twice = reduce(DataFrame.unionByName, [back, *[back.where("id_curso = 2 AND id_usuario % 2 = 0").withColumn("id_curso", F.col("id_curso") + 500000000)] * 2])
    return grid_changes(shown, twice, ["id_curso", "id_usuario"])


def edited_cells(s: Samples) -> DataFrame:
    """Changed cells, rows that went, and rows that cannot be told apart, as one table."""
    edits = _edited(s)
    return (
        edits.changed.select("*", F.lit("cambia").alias("que"))
        .unionByName(edits.removed.select("*", F.lit("falta").alias("que")), allowMissingColumns=True)
        .unionByName(edits.unclear.drop("veces").select("*", F.lit("dudosa").alias("que")), allowMissingColumns=True)
        .withColumn("columnas", F.array_join("columnas", ","))
    )


def edited_status(s: Samples) -> DataFrame:
    full = _edited(s).full.select("id_curso", "id_usuario", "status", "curso_aprobado")
    return updates.set_registrant_status(s.tables, full).tables["registrados_curso"]


# Batches


def _batched(s: Samples, *names: str) -> tuple[str, Tables]:
    folder = new_folder(s.spark)
    store_batches({name: getattr(s.tables, name) for name in names}, folder)
    stored = load_tables(s.spark, folder)
    return folder, s.tables.with_tables(**{name: getattr(stored, name) for name in names})


def two_changes(s: Samples) -> DataFrame:
    """Members added by two changes that were made from one state."""
    folder, t = _batched(s, "comunidad")
    first, second = adds.add_members(t, s.view("nuevos_miembros")), adds.add_members_minimal(t, s.view("miembros_faltantes"))
    write_change(s.spark, first, folder, "alta 1")
    write_change(s.spark, second, folder, "alta 2")
    return load_tables(s.spark, folder).comunidad


def written_again(s: Samples) -> DataFrame:
    """Runs with their sessions, after a change was made and written a second time under its name."""
    folder, t = _batched(s, "curso", "tiene_sesion", "imparte")
    for _ in range(2):
        write_change(s.spark, adds.add_courses(t, s.view("nuevos_cursos")), folder, "cursos de marzo")
        t = t.with_tables(**{n: getattr(load_tables(s.spark, folder), n) for n in ("curso", "tiene_sesion", "imparte")})
    return t.curso.join(t.tiene_sesion, "id_curso")


def appended_twice(s: Samples) -> DataFrame:
    """Class attendance, whose pairs may repeat, written a second time under its name."""
    folder, t = _batched(s, "asistencia_clase")
    batches = s.view("correos_lineas").selectExpr("id_lote", "id_lote AS id_clase", "texto")
    for _ in range(2):
        write_change(s.spark, registrations.register_class_attendance(t, batches, must_exist=False), folder, "lista 7")
    return load_tables(s.spark, folder).asistencia_clase

"""Tables of a catalog, which are read anew by whatever reads them."""

import datetime as dt

import pytest

from tertulia import SCHEMAS, load_tables
from tertulia.operators import adds, registrations, reports
from tertulia.sources import append_rows

DAY = dt.date(2024, 1, 1)
ROWS = {
    "comunidad": [(1, "Ana", "Paz", "ana@x", True, None, "IT", None, None), (2, "Bo", "Roy", "bo@x", True, None, "IT", None, None)],
    "sesion": [(1, "S", DAY, ""), (2, "T", DAY, "")],
    "instructor": [(1, "Eva", "Sol", "e@x")],
    "catalogo_cursos": [(1, "SQL")],
    "curso": [(1, 1, DAY, DAY, "P", True, "c@x")],
    "clase": [(1, 1, DAY)],
    "tiene_sesion": [(1, 1)],
    "imparte": [(1, 1)],
    "asistencia_sesion": [(1, 1), (1, 2)],
    "registrados_curso": [(1, 2, True, True, True)],
    "asistencia_clase": [(1, 1)],
}


@pytest.fixture
def live(spark, tmp_path):
    spark.sql(f"CREATE DATABASE live LOCATION '{tmp_path}/live'")
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.saveAsTable(f"live.{name}")
    yield load_tables(spark, "live", fmt="table")
    spark.sql("DROP DATABASE live CASCADE")


def write(change):
    for name, added in change.added.items():
        append_rows(added, f"live.{name}", fmt="table")


def test_a_report_sees_one_moment(spark, rows, live):
    before = rows(reports.top_participants(live))
    built = reports.top_participants(live)
    twin = spark.createDataFrame([(3, "Ana", "P", "ana@x", True, None, "IT", None, None), (4, "Cy", "R", "cy@x", True, None, "IT", None, None)], SCHEMAS["comunidad"])
    append_rows(twin, "live.comunidad", fmt="table")
    append_rows(spark.createDataFrame([(1, 3), (2, 3), (3, 3), (1, 4)], SCHEMAS["asistencia_sesion"]), "live.asistencia_sesion", fmt="table")
    after = rows(reports.top_participants(live.reload()))
    assert ("ana@x", "IT", 3, 0, 3) in after
    assert ("ana@x", "IT", 1, 0, 1) in before
    assert rows(built) in (before, after)


def test_added_rows_are_written_once_with_one_id(spark, rows, live):
    change = adds.add_catalog(live, spark.createDataFrame([("Spark",)], "nombre_curso string"))
    write(change)
    assert rows(change.added["catalogo_cursos"]) == [(2, "Spark")]
    assert rows(live.reload("catalogo_cursos").catalogo_cursos) == [(1, "SQL"), (2, "Spark")]


def test_added_courses_keep_their_links(spark, rows, live):
    new = spark.createDataFrame(
        [("SQL", DAY, DAY, "R", True, "c@x", ["S"], "Eva Sol")],
        "nombre_curso string, fecha_inicio date, fecha_fin date, proveedor string, requiere_caso_uso boolean, "
        "correo_contacto string, sesiones array<string>, instructor string",
    )
    write(adds.add_courses(live, new))
    state = live.reload("curso", "tiene_sesion", "imparte")
    assert [r[0] for r in rows(state.curso)] == [1, 2]
    assert rows(state.tiene_sesion) == [(1, 1), (2, 1)]
    assert rows(state.imparte) == [(1, 1), (1, 2)]


def test_class_attendance_is_added_once(spark, rows, live):
    batch = spark.createDataFrame([(1, "ana@x\nbo@x")], "id_clase bigint, texto string")
    change = registrations.register_class_attendance(live, batch)
    write(change)
    assert rows(live.reload("asistencia_clase").asistencia_clase) == [(1, 1), (1, 1), (1, 2)]


def test_registering_again_after_a_write_adds_nothing(spark, rows, live):
    batch = spark.createDataFrame([(2, "ana@x")], "id_sesion bigint, texto string")
    write(registrations.register_session_attendance(live, batch))
    state = live.reload("asistencia_sesion")
    assert rows(state.asistencia_sesion) == [(1, 1), (1, 2), (2, 1)]
    assert rows(registrations.register_session_attendance(state, batch).added["asistencia_sesion"]) == []


def test_columns_go_by_name(spark, rows, live):
    turned = spark.createDataFrame([("Spark", 7)], "NOMBRE_CURSO string, ID_CATALOGO int")
    append_rows(turned, "live.catalogo_cursos", fmt="table")
    assert rows(live.reload().catalogo_cursos) == [(1, "SQL"), (7, "Spark")]

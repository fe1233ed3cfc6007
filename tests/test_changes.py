import datetime as dt

import pytest
from pyspark.sql import functions as F

from tertulia.functions.ids import with_new_ids
from tertulia.operators import adds, deletes, reports, rosters, updates
from tertulia.operators import registrations as reg

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def t(make):
    return make(
        comunidad=[
            (1, "Ana", "Paz", "ana@x", True, "Ventas", "IT", "México", False),
            (2, None, None, "bo@x", None, "", None, None, None),
            (3, "Cy", "Roy", "cy@x", False, None, None, None, None),
            (4, "Cy", "Dos", "cy@x", False, None, None, None, None),
        ],
        sesion=[(1, "S", DAY, ""), (2, "T", DAY, None), (3, "S", DAY, None)],
        instructor=[(1, "Eva", "Sol", "e@x"), (2, "Leo", "Mar", "l@x")],
        catalogo_cursos=[(1, "SQL"), (2, "Spark")],
        curso=[(1, 1, DAY, None, "P", True, "c@x"), (2, 2, None, None, "Q", False, "d@x")],
        clase=[(1, 1, DAY)],
        tiene_sesion=[(1, 1), (1, 2), (2, 2)],
        imparte=[(1, 1)],
        invitacion_sesion=[(1, 1)],
        asistencia_sesion=[(1, 1)],
        invitacion_curso=[(1, 1)],
        registrados_curso=[(1, 1, True, True, None), (1, 3, None, None, True)],
        asistencia_clase=[(1, 1), (1, 2)],
    )


# Registering


def texts(spark, key, *pairs):
    return spark.createDataFrame(list(pairs), f"{key} bigint, texto string")


def test_a_batch_with_an_unknown_address_adds_nobody(spark, rows, t):
    batches = texts(spark, "id_sesion", (1, "ANA@x\nbo@x"), (2, "ana@x\nnew@x\nbo@x"), (3, "cy@x"))
    change = reg.register_session_invitees(t, batches)
    assert rows(change.added["invitacion_sesion"]) == [(1, 2), (3, 3), (3, 4)]
    assert rows(change.rejected.select("id_sesion", "correo")) == [(2, "new@x")]
    assert rows(change.tables["invitacion_sesion"]) == [(1, 1), (1, 2), (3, 3), (3, 4)]
    lenient = reg.register_session_invitees(t, batches, strict=False)
    assert rows(lenient.added["invitacion_sesion"]) == [(1, 2), (2, 1), (2, 2), (3, 3), (3, 4)]


def test_two_submissions_for_one_session_are_gated_apart(spark, rows, t):
    batches = spark.createDataFrame(
        [(1, 2, "ana@x\nnew@x"), (2, 2, "ana@x"), (3, 2, "ana@x")],
        "id_lote bigint, id_sesion bigint, texto string",
    )
    change = reg.register_session_invitees(t, batches)
    assert rows(change.added["invitacion_sesion"]) == [(2, 1)]


@pytest.mark.parametrize(
    "function, key, table",
    [
        (reg.register_session_invitees, "id_sesion", "invitacion_sesion"),
        (reg.register_session_attendance, "id_sesion", "asistencia_sesion"),
        (reg.register_course_invitees, "id_curso", "invitacion_curso"),
        (reg.register_course_registrants, "id_curso", "registrados_curso"),
    ],
)
def test_registering_twice_adds_nothing(spark, rows, t, function, key, table):
    batches = texts(spark, key, (1, "ana@x\nbo@x\ncy@x"), (2, "bo@x"))
    once = t.apply(function(t, batches))
    assert rows(getattr(once, table)) != rows(getattr(t, table))
    again = function(once, batches)
    assert rows(again.added[table]) == []
    assert rows(again.tables[table]) == rows(getattr(once, table))


def test_courses_take_the_first_member_of_an_address(spark, rows, t):
    batches = texts(spark, "id_curso", (2, "cy@x\nnew@x"))
    assert rows(reg.register_course_invitees(t, batches).added["invitacion_curso"]) == [(2, 3)]
    change = reg.register_course_registrants(t, batches)
    assert rows(change.added["registrados_curso"]) == [(2, 3, None, None, None)]
    assert rows(change.rejected) == [(2, "new@x")]


def test_sessions_take_every_member_of_an_address(spark, rows, t):
    change = reg.register_session_attendance(t, texts(spark, "id_sesion", (2, "cy@x\nnew@x")))
    assert rows(change.added["asistencia_sesion"]) == [(2, 3), (2, 4)]


def test_class_attendance_repeats_unless_deduped(spark, rows, t):
    batches = texts(spark, "id_clase", (1, "ana@x\ncy@x\nANA@x"))
    assert rows(reg.register_class_attendance(t, batches).added["asistencia_clase"]) == [(1, 1), (1, 3)]
    deduped = reg.register_class_attendance(t, batches, dedupe=True)
    assert rows(deduped.added["asistencia_clase"]) == [(1, 3)]
    twice = t.apply(reg.register_class_attendance(t, batches))
    assert rows(reports.class_attendance(twice, 1))[0][2] == 3


def test_an_empty_batch_adds_nothing(spark, rows, t):
    change = reg.register_session_invitees(t, texts(spark, "id_sesion", (1, " \n"), (2, None)))
    assert rows(change.added["invitacion_sesion"]) == []


# Adding


def test_empty_text_and_choices_not_to_record_become_missing(spark, rows, t):
    new = spark.createDataFrame(
        [("", "Gil", "g@x", True, "No Registrar", "IT", ""), (None, "Gil", "h@x", True, "Ventas", "", "No Registrar")],
        "nombre string, apellido string, correo string, status boolean, negocio string, area string, pais string",
    )
    change = adds.add_members(t, new)
    added = sorted(rows(change.added["comunidad"]), key=lambda r: r[3])
    assert [r[1:] for r in added] == [
        (None, "Gil", "g@x", True, None, "IT", None, None),
        (None, "Gil", "h@x", True, "Ventas", None, None, None),
    ]
    assert {r[0] for r in added} == {5, 6}
    assert change.tables["comunidad"].count() == 6
    assert change.rejected is None


def test_members_known_by_address_need_both_names(spark, rows, t):
    new = spark.createDataFrame(
        [("Gil", "Rey", "g@x"), ("", "Rey", "h@x"), ("Gil", None, "i@x")],
        "nombre string, apellido string, correo string",
    )
    change = adds.add_members_minimal(t, new)
    assert rows(change.added["comunidad"]) == [(5, "Gil", "Rey", "g@x", True, None, None, None, None)]
    assert sorted(r.correo for r in change.rejected.collect()) == ["h@x", "i@x"]


def test_ids_are_dense_unique_and_above_the_old_ones(spark, make):
    current = make(catalogo_cursos=[(7, "a"), (41, "b")]).catalogo_cursos
    # A third of the rows are copies of one row.
    new = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("nombre_curso"))
    ids = with_new_ids(new, "id_catalogo", current)
    found = [r.id_catalogo for r in ids.collect()]
    assert sorted(found) == list(range(42, 3042))
    assert ids.groupBy("nombre_curso").count().where("nombre_curso = 'hot'").first()["count"] == 1000
    again = {(r.id_catalogo, r.nombre_curso) for r in with_new_ids(new.repartition(3), "id_catalogo", current).collect()}
    assert again == {(r.id_catalogo, r.nombre_curso) for r in ids.collect()}


def test_first_id_of_an_empty_table_is_one(spark, rows, make):
    new = spark.createDataFrame([("a",)], "nombre_curso string")
    assert rows(adds.add_catalog(make(), new).tables["catalogo_cursos"]) == [(1, "a")]


def test_sessions_and_classes_and_instructors(spark, rows, t):
    sessions = spark.createDataFrame([("U", DAY), ("", DAY), ("V", None)], "nombre_sesion string, fecha_sesion date")
    change = adds.add_sessions(t, sessions)
    assert rows(change.added["sesion"]) == [(4, "U", DAY, "")]
    assert change.rejected.count() == 2
    classes = spark.createDataFrame([(1, DAY), (2, None)], "id_curso bigint, fecha date")
    assert rows(adds.add_classes(t, classes).added["clase"]) == [(2, 1, DAY)]
    people = spark.createDataFrame(
        [("Io", "Luz", "i@x"), ("Io", "", "j@x")],
        "nombre_instructor string, apellido_instructor string, correo_instructor string",
    )
    assert rows(adds.add_instructors(t, people).added["instructor"]) == [(3, "Io", "Luz", "i@x")]


def test_courses_are_linked_to_their_own_run(spark, rows, t):
    new = spark.createDataFrame(
        [
            ("SQL", DAY, DAY, "P", True, "c@x", ["S", "T", "Nada"], "Eva Sol"),
            ("SQL", DAY, DAY, "R", True, "c@x", ["T"], "Nadie"),
            ("SQL", None, DAY, "P", True, "c@x", ["T"], "Eva Sol"),
            ("Otro", DAY, DAY, "P", True, "c@x", ["T"], "Eva Sol"),
        ],
        "nombre_curso string, fecha_inicio date, fecha_fin date, proveedor string, requiere_caso_uso boolean, "
        "correo_contacto string, sesiones array<string>, instructor string",
    )
    change = adds.add_courses(t, new)
    ids = {r.proveedor: r.id_curso for r in change.added["curso"].collect()}
    assert set(ids.values()) == {3, 4}
    assert rows(change.added["tiene_sesion"]) == sorted([(ids["P"], 1), (ids["P"], 2), (ids["R"], 2)])
    assert rows(change.added["imparte"]) == [(1, ids["P"])]
    assert change.rejected.count() == 2
    assert change.tables["curso"].columns == t.curso.columns


def test_a_session_named_twice_is_linked_once(spark, rows, t):
    new = spark.createDataFrame(
        [("SQL", DAY, DAY, "P", True, "c@x", ["S", "S", "T", "S"], "Eva Sol")],
        "nombre_curso string, fecha_inicio date, fecha_fin date, proveedor string, requiere_caso_uso boolean, "
        "correo_contacto string, sesiones array<string>, instructor string",
    )
    assert rows(adds.add_courses(t, new).added["tiene_sesion"]) == [(3, 1), (3, 2)]


# Updating


def test_update_members(spark, rows, t):
    changes = spark.createDataFrame(
        [("ana@x", None, "Sol", "ana.sol@x", False, "Finanzas"), ("bo@x", "Bo", None, None, True, "Finanzas")],
        "correo string, nombre string, apellido string, correo_nuevo string, status boolean, negocio string",
    )
    found = rows(updates.update_members(t, changes).tables["comunidad"])
    assert found[0] == (1, "Ana", "Sol", "ana.sol@x", False, "Ventas", "IT", "México", False)
    assert found[1] == (2, "Bo", None, "bo@x", True, None, None, None, None)
    assert found[2:] == rows(t.comunidad)[2:]
    free = rows(updates.update_members(t, changes, keep_profile=False).tables["comunidad"])
    assert [r[5] for r in free] == ["Finanzas", "Finanzas", None, None]


def test_changed_and_removed_rows_alone(spark, rows, t):
    changes = spark.createDataFrame(
        [(1, 1, None, True), (1, 9, True, True)],
        "id_curso bigint, id_usuario bigint, status boolean, curso_aprobado boolean",
    )
    assert rows(updates.set_registrant_status(t, changes).changed["registrados_curso"]) == [(1, 1, False, True, True)]
    links = spark.createDataFrame([(1, "S")], "id_curso bigint, nombre_sesion string")
    replaced = updates.replace_course_sessions(t, links)
    assert rows(replaced.removed["tiene_sesion"]) == [(1, 1), (1, 2)]
    assert rows(replaced.added["tiene_sesion"]) == [(1, 1), (1, 3)]
    gone = deletes.delete_members(t, t.comunidad.select("id_usuario"))
    assert [r[0] for r in rows(gone.removed["comunidad"])] == [2, 4]


def test_two_changes_of_one_row(spark, rows, t):
    changes = spark.createDataFrame(
        [(1, "U", 1), (1, "V", 2)], "id_sesion bigint, nombre_sesion string, orden bigint"
    )
    change = updates.update_sessions(t, changes, order_col="orden")
    assert rows(change.tables["sesion"])[0] == (1, "V", DAY, "")
    with pytest.raises(Exception, match="two changes for one id_sesion"):
        updates.update_sessions(t, changes.drop("orden")).tables["sesion"].collect()


def test_update_courses(spark, rows, t):
    changes = spark.createDataFrame(
        [(1, None, DAY, False)], "id_curso bigint, proveedor string, fecha_fin date, requiere_caso_uso boolean"
    )
    found = rows(updates.update_courses(t, changes).tables["curso"])
    assert found == [(1, 1, DAY, DAY, "P", False, "c@x"), (2, 2, None, None, "Q", False, "d@x")]


def test_replace_course_sessions(spark, rows, t):
    links = spark.createDataFrame(
        [(1, "S"), (1, "S"), (1, "Nada"), (2, None)], "id_curso bigint, nombre_sesion string"
    )
    change = updates.replace_course_sessions(t, links)
    assert rows(change.tables["tiene_sesion"]) == [(1, 1), (1, 3)]


def test_reassign_instructor(spark, rows, t):
    changes = spark.createDataFrame([(1, "Leo Mar"), (2, "Eva Sol")], "id_curso bigint, instructor string")
    change = updates.reassign_instructor(t, changes)
    assert rows(change.tables["imparte"]) == [(2, 1)]
    unknown = spark.createDataFrame([(1, "Nadie")], "id_curso bigint, instructor string")
    change = updates.reassign_instructor(t, unknown)
    assert rows(change.tables["imparte"]) == [(1, 1)]
    assert rows(change.rejected) == [(1, "Nadie")]


def test_registrant_status(spark, rows, t):
    changes = spark.createDataFrame(
        [(1, 1, None, True), (1, 9, True, True)],
        "id_curso bigint, id_usuario bigint, status boolean, curso_aprobado boolean",
    )
    found = rows(updates.set_registrant_status(t, changes).tables["registrados_curso"])
    assert found == [(1, 1, False, True, True), (1, 3, None, None, True)]


# Deleting


def test_guarded_deletes(spark, rows, t):
    everyone = t.comunidad.select("id_usuario")
    change = deletes.delete_members(t, everyone)
    assert [r[0] for r in rows(change.tables["comunidad"])] == [1, 3]
    assert rows(change.rejected) == [(1,), (3,)]
    strict = deletes.delete_members(t, everyone, strict=True)
    assert [r[0] for r in rows(strict.tables["comunidad"])] == [1, 2, 3]

    sessions = t.sesion.select("id_sesion")
    assert [r[0] for r in rows(deletes.delete_sessions(t, sessions).tables["sesion"])] == [1]
    strict = deletes.delete_sessions(t, sessions, strict=True)
    assert [r[0] for r in rows(strict.tables["sesion"])] == [1, 2]

    runs = t.curso.select("id_curso")
    assert [r[0] for r in rows(deletes.delete_courses(t, runs).tables["curso"])] == [1]
    assert [r[0] for r in rows(deletes.delete_courses(t, runs, strict=True).tables["curso"])] == [1, 2]


def test_deleting_only_what_depends_changes_nothing(spark, rows, t):
    blocked = spark.createDataFrame([(1,), (3,), (99,)], "id_usuario bigint")
    change = deletes.delete_members(t, blocked)
    assert rows(change.tables["comunidad"]) == rows(t.comunidad)
    assert rows(change.rejected) == [(1,), (3,)]


def test_invited_is_attended_and_invited_plus_no_shows(spark, t):
    batches = texts(spark, "id_sesion", (1, "ana@x\nbo@x\ncy@x"), (2, "bo@x"))
    after = t.apply(reg.register_session_invitees(t, batches))
    invited = rosters.session_invitees(after).count()
    both = after.invitacion_sesion.join(after.asistencia_sesion, ["id_sesion", "id_usuario"], "left_semi").count()
    assert invited == both + rosters.session_no_shows(after).count()


# Several changes of one key


def test_the_others_go_on(spark, rows, t):
    shape = "id_curso long, id_usuario long, status boolean, curso_aprobado boolean"
    changes = [(1, 1, False, True), (1, 1, True, True), (1, 3, True, True), (1, 3, True, True), (None, 1, True, True), (9, 9, None, None)]
    given = spark.createDataFrame(changes, shape)
    with pytest.raises(Exception, match="two changes for one"):
        rows(updates.set_registrant_status(t, given).tables["registrados_curso"])
    change = updates.set_registrant_status(t, given, go_on=True)
    assert rows(change.changed["registrados_curso"]) == [(1, 3, True, None, True)]
    assert rows(change.replaced["registrados_curso"]) == [(1, 3, None, None, True)]
    assert rows(change.rejected) == [(1, 1, False, True), (1, 1, True, True)]


def test_instructors_named_twice_are_rejected(spark, rows, t):
    given = spark.createDataFrame([(1, "Leo Mar"), (1, "Eva Sol"), (2, "Leo Mar"), (1, "Nadie")], "id_curso long, instructor string")
    change = updates.reassign_instructor(t, given, go_on=True)
    assert rows(change.tables["imparte"]) == [(1, 1)]
    assert rows(change.rejected) == [(1, "Eva Sol"), (1, "Leo Mar"), (1, "Nadie")]


def test_members_and_sessions_go_on(spark, rows, t):
    members = spark.createDataFrame([("ana@x", "A"), ("ana@x", "B"), ("bo@x", "Bo")], "correo string, nombre string")
    change = updates.update_members(t, members, go_on=True)
    assert [r[1] for r in rows(change.tables["comunidad"])] == ["Ana", "Bo", "Cy", "Cy"] and change.rejected.count() == 2
    sessions = spark.createDataFrame([(1, "X"), (2, "Y"), (2, "Z")], "id_sesion long, nombre_sesion string")
    assert [r[1] for r in rows(updates.update_sessions(t, sessions, go_on=True).tables["sesion"])] == ["X", "T", "S"]


def test_columns_without_a_type_are_missing_values(spark, rows, t):
    pairs = t.registrados_curso.select("id_curso", "id_usuario")
    none = pairs.withColumn("status", F.lit(None)).withColumn("curso_aprobado", F.lit(None))
    after = updates.set_registrant_status(t, none).tables["registrados_curso"]
    assert after.count() == pairs.count() and after.where("status OR curso_aprobado").count() == 0
    cleared = t.tiene_sesion.select("id_curso").withColumn("nombre_sesion", F.lit(None))
    assert updates.replace_course_sessions(t, cleared).tables["tiene_sesion"].count() == 0

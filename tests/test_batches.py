"""Writing a change more than once, and changes made from one state."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from tertulia import SCHEMAS, load_tables
from tertulia.operators import adds, registrations
from tertulia.sources import batches
from tertulia.sources.files import create_new, exists

DAY = dt.date(2024, 1, 1)
ROWS = {
    "comunidad": [(1, "Ana", "Paz", "ana@x", True, None, "IT", None, None), (2, "Bo", "Roy", "bo@x", True, None, "IT", None, None)],
    "sesion": [(1, "S", DAY, ""), (2, "T", DAY, "")],
    "instructor": [(1, "Eva", "Sol", "e@x")],
    "catalogo_cursos": [(1, "SQL")],
    "curso": [(4, 1, DAY, DAY, "P", True, "c@x")],
    "clase": [(1, 4, DAY)],
    "tiene_sesion": [(4, 1)],
    "imparte": [(1, 4)],
    "asistencia_clase": [(1, 1)],
}
COURSE = (
    "nombre_curso string, fecha_inicio date, fecha_fin date, proveedor string, requiere_caso_uso boolean, "
    "correo_contacto string, sesiones array<string>, instructor string"
)


@pytest.fixture
def folder(spark, tmp_path):
    batches.store_batches({n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in ROWS.items()}, str(tmp_path))
    return str(tmp_path)


def people(spark, *names):
    return spark.createDataFrame([(n, "P", f"{n}@x") for n in names], "nombre string, apellido string, correo string")


def run(spark, provider):
    return spark.createDataFrame([("SQL", DAY, DAY, provider, True, "c@x", ["S", "T"], "Eva Sol")], COURSE)


def test_two_changes_from_one_state_share_no_id(spark, rows, folder):
    t = load_tables(spark, folder)
    first, second = adds.add_members_minimal(t, people(spark, "cy", "di")), adds.add_members_minimal(t, people(spark, "ed", "flo", "gus"))
    assert {r[0] for r in rows(first.added["comunidad"])} < {r[0] for r in rows(second.added["comunidad"])}
    batches.write_change(spark, second, folder, "b")
    batches.write_change(spark, first, folder, "a")
    now = rows(load_tables(spark, folder).comunidad)
    assert [r[0] for r in now] == [1, 2, 3, 4, 5, 6, 7]
    assert {r[3] for r in now[2:5]} == {"ed@x", "flo@x", "gus@x"}


def test_links_move_with_their_runs(spark, rows, folder):
    t = load_tables(spark, folder)
    changes = [adds.add_courses(t, run(spark, p)) for p in ("Q", "R")]
    for name, change in zip("ab", changes):
        batches.write_change(spark, change, folder, name)
    t = load_tables(spark, folder)
    assert [(r[0], r[4]) for r in rows(t.curso)] == [(4, "P"), (5, "Q"), (6, "R")]
    assert rows(t.tiene_sesion) == [(4, 1), (5, 1), (5, 2), (6, 1), (6, 2)]
    assert rows(t.imparte) == [(1, 4), (1, 5), (1, 6)]


def test_a_class_of_a_new_run_keeps_its_run(spark, rows, folder):
    """Ids of another table are not moved along."""
    t = load_tables(spark, folder)
    new = spark.createDataFrame([(4, DAY)], "id_curso long, fecha date")
    for name, change in [("a", adds.add_classes(t, new)), ("b", adds.add_classes(t, new))]:
        batches.write_change(spark, change, folder, name)
    assert rows(load_tables(spark, folder).clase) == [(1, 4, DAY), (2, 4, DAY), (3, 4, DAY)]


def test_writing_twice_leaves_one_copy(spark, rows, folder):
    batch = spark.createDataFrame([(1, "ana@x\nbo@x")], "id_clase long, texto string")
    written = []
    for _ in range(2):  # the second time the change is made anew, from the state the first one left
        change = registrations.register_class_attendance(load_tables(spark, folder), batch)
        written.append(batches.write_change(spark, change, folder, "lista/1 = ñ"))
    assert written == [["asistencia_clase"], []]
    assert rows(load_tables(spark, folder).asistencia_clase) == [(1, 1), (1, 1), (1, 2)]
    change = registrations.register_class_attendance(load_tables(spark, folder), batch)
    batches.write_change(spark, change, folder, "lista 2")
    assert load_tables(spark, folder).asistencia_clase.count() == 5


def test_a_lost_driver_is_completed(spark, rows, folder, monkeypatch):
    """The links are there, the run is not; made and written again, the run comes with the logged id."""
    real, done = batches.append_batch, []

    def dies(df, path, batch):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(path)
        return real(df, path, batch)

    monkeypatch.setattr(batches, "append_batch", dies)
    with pytest.raises(RuntimeError):
        batches.write_change(spark, adds.add_courses(load_tables(spark, folder), run(spark, "Q")), folder, "a")
    t = load_tables(spark, folder)
    assert rows(t.tiene_sesion) == [(4, 1), (5, 1), (5, 2)] and [r[0] for r in rows(t.curso)] == [4]
    monkeypatch.setattr(batches, "append_batch", real)
    batches.write_change(spark, adds.add_courses(t, run(spark, "X")), folder, "other")  # takes no logged id
    assert batches.write_change(spark, adds.add_courses(t, run(spark, "Q")), folder, "a") == ["curso"]
    t = load_tables(spark, folder)
    assert [(r[0], r[4]) for r in rows(t.curso)] == [(4, "P"), (5, "Q"), (6, "X")]
    assert rows(t.tiene_sesion) == [(4, 1), (5, 1), (5, 2), (6, 1), (6, 2)]


def test_a_half_written_log_is_written_anew(spark, rows, folder):
    spark.createDataFrame([(99, "Half")], SCHEMAS["catalogo_cursos"]).write.parquet(f"{folder}/_lotes/a/catalogo_cursos")
    new = spark.createDataFrame([("Spark",)], "nombre_curso string")
    batches.write_change(spark, adds.add_catalog(load_tables(spark, folder), new), folder, "a")
    assert rows(load_tables(spark, folder).catalogo_cursos) == [(1, "SQL"), (2, "Spark")]


def test_claims_at_one_time_are_disjoint(spark, folder):
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda n: (batches.claim_ids(spark, folder, "comunidad", 3, n), n), [5, 3, 4, 2, 6, 1]))
    taken = sorted(i for first, n in firsts for i in range(first, first + n))
    assert taken == list(range(3, 3 + 21))


def test_an_unfinished_claim_is_waited_for(spark, folder):
    create_new(spark, f"{folder}/_ids/comunidad/1", "")
    with pytest.raises(RuntimeError, match="never finished"):
        batches.claim_ids(spark, folder, "comunidad", 3, 1, patience=0.5)
    assert not create_new(spark, f"{folder}/_ids/comunidad/1", "7") and exists(spark, f"{folder}/_ids/comunidad/1")


def test_nothing_to_add(spark, rows, folder):
    t = load_tables(spark, folder)
    none = adds.add_members_minimal(t, people(spark))
    batches.write_change(spark, none, folder, "a")
    assert rows(load_tables(spark, folder).comunidad) == rows(t.comunidad)

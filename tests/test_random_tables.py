"""Reports and rosters on small random tables, against plain SQL joins in DuckDB.

These tables hold what the samples do not: members who share an address and area, copies in the
participation tables, a member and a session with a third of all rows, ids that no entity has,
names that repeat.
"""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pytest

from samples.oracle import ORACLE
from samples.queries import QUERIES
from tertulia import SCHEMAS, Tables
from tests.check import rows_of

ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32()}
KEYS = [
    "member_listing", "member_labels", "session_listing", "session_ids", "catalog_id", "course_details",
    "runs_of_course", "course_labels", "course_labels_year_first", "course_by_label", "class_attendees",
    "session_invitees", "session_attendees", "course_invitees", "course_registrants",
    "course_registrant_status", "course_classes", "course_sessions", "member_sessions", "member_courses",
    "session_no_shows", "course_not_registered", "member_missed_sessions", "member_missed_courses",
    "session_funnel", "course_funnel", "engagement_summary", "engagement_breakdown", "top_participants",
    "top_participants_area", "popular_courses", "runs_per_course", "completion_rates",
    "session_attendance_pct", "invite_recommendations", "class_attendance", "class_attendance_bitmaps",
    "class_attendance_stored_bitmaps", "member_dependents",
    "member_dependents_strict", "session_dependents", "session_dependents_strict", "course_dependents",
    "course_dependents_strict", "delete_members", "delete_members_blocked", "delete_sessions",
    "delete_sessions_blocked", "delete_courses", "delete_courses_blocked", "delete_courses_strict",
]


def random_tables(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    flag = lambda: r.choice([True, False, None])
    day = lambda: r.choice([None, dt.date(2024, r.randint(1, 3), r.randint(1, 4))])
    members = [
        (i, r.choice([None, "Ana", "Bo"]), r.choice([None, "Paz"]), f"m{r.randint(1, 12)}@x.com", flag(),
         None, r.choice([None, "IT", "Comercial"]), None, flag())
        for i in range(1, 31)
    ]

    def links(n: int, left: int, right: int, flags: int = 0) -> list[tuple]:
        """Pairs with copies; the id 1 has a third of the rows on either side."""
        pick = lambda top: 1 if r.random() < 1 / 3 else r.randint(1, top)
        return [(pick(left), pick(right), *(flag() for _ in range(flags))) for _ in range(n)]

    return {
        "comunidad": members,
        "catalogo_cursos": [(i, f"Curso {r.randint(1, 4)}") for i in range(1, 7)],
        "curso": [(i, r.randint(1, 8), day(), day(), "P", flag(), "c@x.com") for i in range(1, 16)],
        "sesion": [(i, f"S{r.randint(1, 6)}", dt.date(2024, 1, 1), None) for i in range(1, 11)],
        "clase": [(i, r.randint(1, 16), dt.date(2024, 1, r.randint(1, 3))) for i in range(1, 26)],
        "tiene_sesion": links(20, 17, 12),
        "imparte": links(10, 3, 17),
        "invitacion_sesion": links(120, 12, 33),
        "asistencia_sesion": links(90, 11, 33),
        "invitacion_curso": links(120, 17, 33),
        "registrados_curso": links(80, 17, 25, flags=3),
        "asistencia_clase": links(150, 27, 33),
        "instructor": [(1, "Eva", "Sol", "e@x.com")],
    }


class Small:
    def __init__(self, tables):
        self.tables = tables


@pytest.fixture(scope="module", params=[1, 2, 3])
def pair(request, spark):
    """The same tables in Spark and in DuckDB; the second set has empty facts, the third members
    with one address each."""
    data = random_tables(request.param)
    if request.param == 2:
        data |= {"asistencia_sesion": [], "registrados_curso": [], "asistencia_clase": []}
    if request.param == 3:
        data["comunidad"] = [(m[0], m[1], m[2], f"u{m[0]}@x.com", *m[4:]) for m in data["comunidad"]]
    con = duckdb.connect()
    for name, schema in SCHEMAS.items():
        columns = list(zip(*data[name])) or [[] for _ in schema]
        arrays = [pa.array(c, ARROW[f.dataType.simpleString()]) for c, f in zip(columns, schema)]
        con.register(name, pa.table(dict(zip(schema.names, arrays))))
    return Small(Tables(lambda name: spark.createDataFrame(data[name], SCHEMAS[name]))), con


@pytest.mark.parametrize("name", KEYS)
def test_equals_sql(pair, name):
    samples, con = pair
    df = QUERIES[name](samples)
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())

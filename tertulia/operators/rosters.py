"""Who was invited, who came, and who did not.

Each roster answers for every session, run or member at once. An id or address narrows it, and
the filter reaches the scan of the participation table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.operators.lookups import where_equal
from tertulia.plans.joins import repeat_rows, without_match
from tertulia.sources.tables import Tables

PERSON = ["nombre", "apellido", "correo"]


def _people(t: Tables, links: DataFrame, key: str, *more: str) -> DataFrame:
    people = t.comunidad.select("id_usuario", *PERSON)
    return links.join(people, "id_usuario").select(key, *PERSON, *more)


def session_invitees(t: Tables, id_sesion: int | None = None) -> DataFrame:
    return _people(t, where_equal(t.invitacion_sesion, "id_sesion", id_sesion), "id_sesion")


def session_attendees(t: Tables, id_sesion: int | None = None) -> DataFrame:
    return _people(t, where_equal(t.asistencia_sesion, "id_sesion", id_sesion), "id_sesion")


def course_invitees(t: Tables, id_curso: int | None = None) -> DataFrame:
    return _people(t, where_equal(t.invitacion_curso, "id_curso", id_curso), "id_curso")


def course_registrants(t: Tables, id_curso: int | None = None, with_status: bool = False) -> DataFrame:
    """Registrants of a run; `with_status` adds their id, status and completion flag."""
    links = where_equal(t.registrados_curso, "id_curso", id_curso)
    if not with_status:
        return _people(t, links, "id_curso")
    flags = links.select("id_curso", "id_usuario", "status", "curso_aprobado")
    return _people(t, flags, "id_curso", "id_usuario", "status", "curso_aprobado")


def course_classes(t: Tables, id_curso: int | None = None) -> DataFrame:
    classes = where_equal(t.clase, "id_curso", id_curso)
    return classes.join(t.curso.select("id_curso"), "id_curso").select("id_curso", "id_clase", "fecha")


def course_sessions(t: Tables, id_curso: int | None = None) -> DataFrame:
    links = where_equal(t.tiene_sesion, "id_curso", id_curso)
    return links.join(t.sesion, "id_sesion").select("id_curso", "id_sesion", "nombre_sesion")


def _absent(invited: DataFrame, present: DataFrame, key: str, value: int | None) -> DataFrame:
    pair = [key, "id_usuario"]
    return without_match(where_equal(invited, key, value), where_equal(present, key, value), pair)


def session_no_shows(t: Tables, id_sesion: int | None = None) -> DataFrame:
    """Invited to a session and absent from it."""
    absent = _absent(t.invitacion_sesion, t.asistencia_sesion, "id_sesion", id_sesion)
    return repeat_rows(_people(t, absent, "id_sesion", "copias")).drop("_copy")


def course_not_registered(t: Tables, id_curso: int | None = None) -> DataFrame:
    """Invited to a run and not registered for it."""
    absent = _absent(t.invitacion_curso, t.registrados_curso, "id_curso", id_curso)
    return repeat_rows(_people(t, absent, "id_curso", "copias")).drop("_copy")


# One member's record


def _of_members(t: Tables, links: DataFrame, correo: str | None) -> DataFrame:
    """Links with the address of their member, or the links of one address.

    The one member's id goes to the scan as a scalar, so no large table is shuffled. An address
    held by two members is an error there.
    """
    if correo is None:
        return links.join(t.comunidad.select("id_usuario", "correo"), "id_usuario")
    member = t.comunidad.where(F.col("correo") == correo).select("id_usuario")
    return links.where(links["id_usuario"] == member.scalar()).withColumn("correo", F.lit(correo))


def _missed(t: Tables, invited: DataFrame, present: DataFrame, key: str, correo: str | None) -> DataFrame:
    if correo is None:
        return _of_members(t, _absent(invited, present, key, None), None)
    mine = (_of_members(t, links, correo) for links in (invited, present))
    return _absent(*mine, key, None).withColumn("correo", F.lit(correo))


def _runs(t: Tables, *cols: str) -> DataFrame:
    named = t.curso.join(t.catalogo_cursos, "id_catalogo")
    return named.select("id_curso", "nombre_curso", *cols)


def member_sessions(t: Tables, correo: str | None = None) -> DataFrame:
    attended = _of_members(t, t.asistencia_sesion, correo).join(t.sesion, "id_sesion")
    return attended.select("correo", "nombre_sesion", "fecha_sesion")


def member_courses(t: Tables, correo: str | None = None) -> DataFrame:
    taken = _of_members(t, t.registrados_curso, correo)
    return taken.join(_runs(t, "fecha_inicio", "fecha_fin"), "id_curso").select(
        "correo", "nombre_curso", "fecha_inicio", "fecha_fin", "solicitud_aprobada", "curso_aprobado"
    )


def member_missed_sessions(t: Tables, correo: str | None = None) -> DataFrame:
    """Sessions a member was invited to and missed."""
    missed = _missed(t, t.invitacion_sesion, t.asistencia_sesion, "id_sesion", correo)
    rows = missed.join(t.sesion, "id_sesion").select("correo", "nombre_sesion", "fecha_sesion", "copias")
    return repeat_rows(rows).drop("_copy")


def member_missed_courses(t: Tables, correo: str | None = None) -> DataFrame:
    """Runs a member was invited to and did not register for."""
    missed = _missed(t, t.invitacion_curso, t.registrados_curso, "id_curso", correo)
    rows = missed.join(_runs(t, "fecha_inicio"), "id_curso").select(
        "correo", "nombre_curso", "fecha_inicio", "copias"
    )
    return repeat_rows(rows).drop("_copy")

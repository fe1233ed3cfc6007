"""Adding members, instructors, sessions, courses and classes, many rows at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.functions.ids import with_new_ids
from tertulia.functions.text import NOT_RECORDED, is_blank
from tertulia.operators.lookups import catalog_id, instructor_id, session_ids
from tertulia.plans.joins import split_known
from tertulia.plans.staging import stage
from tertulia.schemas import SCHEMAS
from tertulia.sources.tables import Change, Tables


def _split(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows with every required field filled in, and the others."""
    if not required:
        return rows, None
    lacking = reduce(or_, [is_blank(c) for c in required])
    return rows.where(~lacking), rows.where(lacking)


def _conform(rows: DataFrame, table: str, id_col: str, defaults: Mapping[str, object]) -> DataFrame:
    """The table's columns but its id, in order; a column not given takes its default or null."""

    def column(name: str, dtype) -> Column:
        value = F.col(name) if name in rows.columns else F.lit(defaults.get(name))
        return value.cast(dtype).alias(name)

    return rows.select(*[column(f.name, f.dataType) for f in SCHEMAS[table] if f.name != id_col])


def _insert(
    t: Tables,
    table: str,
    id_col: str,
    rows: DataFrame,
    required: Sequence[str] = (),
    defaults: Mapping[str, object] | None = None,
) -> Change:
    current = getattr(t, table)
    valid, invalid = _split(rows, required)
    new = _conform(valid, table, id_col, defaults or {})
    # Staged: the ids stay what they are once the rows have been appended to a table read live.
    added = stage(with_new_ids(new, id_col, current).select(*current.columns))
    return Change({table: current.unionByName(added)}, {table: added}, invalid)


def add_members(
    t: Tables,
    rows: DataFrame,
    required: Sequence[str] = (),
    defaults: Mapping[str, object] | None = None,
) -> Change:
    """Add members from a form or grid. Empty text is stored as missing, and so is a choice not
    to record business, area or country."""
    absent = {"nombre": [""], "apellido": [""]} | {c: ["", NOT_RECORDED] for c in ("negocio", "area", "pais")}
    recorded = {
        c: F.when(~F.col(c).isin(values), F.col(c)) for c, values in absent.items() if c in rows.columns
    }
    return _insert(t, "comunidad", "id_usuario", rows.withColumns(recorded), required, defaults)


def add_members_minimal(t: Tables, rows: DataFrame) -> Change:
    """Add members known by address and full name only; they start out active."""
    named = rows.select("nombre", "apellido", "correo")
    return add_members(t, named, required=["nombre", "apellido"], defaults={"status": True})


def add_instructors(t: Tables, rows: DataFrame) -> Change:
    fields = ["nombre_instructor", "apellido_instructor", "correo_instructor"]
    return _insert(t, "instructor", "id_instructor", rows, required=fields)


def add_sessions(t: Tables, rows: DataFrame) -> Change:
    """Add sessions; a link left out is stored as empty text."""
    link = F.col("link_sesion_informativa") if "link_sesion_informativa" in rows.columns else F.lit(None)
    linked = rows.withColumn("link_sesion_informativa", F.coalesce(link.cast("string"), F.lit("")))
    return _insert(t, "sesion", "id_sesion", linked, required=["nombre_sesion", "fecha_sesion"])


def add_catalog(t: Tables, rows: DataFrame) -> Change:
    return _insert(t, "catalogo_cursos", "id_catalogo", rows, required=["nombre_curso"])


def add_classes(t: Tables, rows: DataFrame, must_exist: bool = True) -> Change:
    """Add classes to runs. Classes of a run that does not exist are rejected, as those without a run or a
    date are; `must_exist=False` takes any run, for rows that come ahead of theirs."""
    if not must_exist:
        return _insert(t, "clase", "id_clase", rows, required=["id_curso", "fecha"])
    valid, invalid = _split(rows, ["id_curso", "fecha"])
    known, unknown = split_known(valid, t.curso, "id_curso")
    change = _insert(t, "clase", "id_clase", known)
    return replace(change, rejected=invalid.unionByName(unknown))


def _named(ids: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The ids of the names in `rows` alone, staged."""
    return stage(ids.join(rows.select(name).distinct(), name, "left_semi"))


def add_courses(t: Tables, rows: DataFrame) -> Change:
    """Add course runs with the sessions and the instructor they are linked to.

    `rows` has nombre_curso, fecha_inicio, fecha_fin, proveedor, requiere_caso_uso,
    correo_contacto, sesiones (array of session names) and instructor (full name). Links go to
    the id given to that very run. A run without a name or a date, or of a course that is not in
    the catalogue, is rejected; names of sessions and instructors that do not exist add no link.
    A session named twice is linked once. The ids of the names at hand are staged, so that a name
    most runs use can be split between tasks.
    """
    valid, invalid = _split(rows, ["nombre_curso", "fecha_inicio", "fecha_fin"])
    catalog = _named(catalog_id(t), valid, "nombre_curso")
    rejected = invalid.unionByName(valid.join(catalog, "nombre_curso", "left_anti").select(*rows.columns))
    named = valid.join(catalog, "nombre_curso").select("id_catalogo", *rows.columns)
    # Staged: the three tables below must agree on the ids, whichever is written first.
    runs = stage(with_new_ids(named, "id_curso", t.curso))

    sessions = runs.select("id_curso", F.explode(F.array_distinct("sesiones")).alias("nombre_sesion"))
    teachers = runs.select("id_curso", F.col("instructor").alias("nombre_completo"))
    added = {
        "curso": runs.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS["curso"]]),
        "tiene_sesion": sessions.join(_named(session_ids(t), sessions, "nombre_sesion"), "nombre_sesion").select(
            "id_curso", "id_sesion"
        ),
        "imparte": teachers.join(_named(instructor_id(t), teachers, "nombre_completo"), "nombre_completo").select(
            "id_instructor", "id_curso"
        ),
    }
    return Change({name: getattr(t, name).unionByName(df) for name, df in added.items()}, added, rejected)

"""Changing rows that exist. A missing value in a change leaves the old value as it is.

Where a key has several different changes and no order column tells which is the last, the whole batch is an error;
with `go_on` the other keys are changed, and the rows of that key are rejected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.operators.lookups import instructor_id, session_ids
from tertulia.plans.joins import drop_keys, settled
from tertulia.plans.staging import stage
from tertulia.sources.tables import Change, Tables

HIT = "_cambia"


def _update(
    t: Tables,
    table: str,
    keys: Sequence[str],
    single: DataFrame,
    new_values: Mapping[str, Column],
    rejected: DataFrame | None = None,
) -> Change:
    """`table` with `new_values` in the rows that a change names; `single` has one change per key.

    `new_values` may use the columns of the change, which carry the prefix `n_`. The changed rows
    alone come from an inner join: a small batch is broadcast to the table, which is then scanned
    and neither sorted nor rewritten. Two changes for one key are an error where a changed column
    is read.
    """
    current = getattr(t, table)
    renamed = single.select(
        *keys, *[F.col(c).alias(f"n_{c}") for c in single.columns if c not in keys], F.lit(True).alias(HIT)
    )

    def value(name: str) -> Column:
        if name not in new_values:
            return F.col(name)
        return F.when(F.col(HIT), new_values[name]).otherwise(F.col(name)).alias(name)

    state, hit = (current.join(renamed, list(keys), how) for how in ("left", "inner"))
    new, old = [value(c) for c in current.columns], current.columns
    return Change({table: state.select(*new)}, rejected=rejected, changed={table: hit.select(*new)}, replaced={table: hit.select(*old)})


def _keep_old(*cols: str) -> dict[str, Column]:
    return {c: F.coalesce(F.col(f"n_{c}"), F.col(c)) for c in cols}


def _given(changes: DataFrame, *cols: str) -> list[str]:
    return [c for c in cols if c in changes.columns]


def update_members(
    t: Tables, changes: DataFrame, order_col: str | None = None, keep_profile: bool = True, go_on: bool = False
) -> Change:
    """Change members found by `correo`; `correo_nuevo` is their new address.

    Business, area and country keep their old value, empty text becoming missing, unless
    `keep_profile` is off.
    """
    profile = ["negocio", "area", "pais"]
    values = _keep_old(*_given(changes, "nombre", "apellido", "status", "baja_empresa"))
    if "correo_nuevo" in changes.columns:
        values["correo"] = F.coalesce("n_correo_nuevo", "correo")
    values |= {c: F.nullif(F.col(c), F.lit("")) for c in profile}
    if not keep_profile:
        values |= _keep_old(*_given(changes, *profile))
    # Staged: many members may share an address, and a join with a stored table can be split.
    single, rejected = settled(changes, ["correo"], order_col, go_on)
    return _update(t, "comunidad", ["correo"], stage(single), values, rejected)


def update_sessions(t: Tables, changes: DataFrame, order_col: str | None = None, go_on: bool = False) -> Change:
    values = _keep_old(*_given(changes, "nombre_sesion", "fecha_sesion", "link_sesion_informativa"))
    single, rejected = settled(changes, ["id_sesion"], order_col, go_on)
    return _update(t, "sesion", ["id_sesion"], single, values, rejected)


def update_courses(t: Tables, changes: DataFrame, order_col: str | None = None, go_on: bool = False) -> Change:
    fields = ["fecha_inicio", "fecha_fin", "proveedor", "requiere_caso_uso", "correo_contacto"]
    values = _keep_old(*_given(changes, *fields))
    single, rejected = settled(changes, ["id_curso"], order_col, go_on)
    return _update(t, "curso", ["id_curso"], single, values, rejected)


def replace_course_sessions(t: Tables, links: DataFrame) -> Change:
    """Replace the session links of every run in `links` (id_curso, nombre_sesion).

    All sessions of a name are linked, each once; a row without a name just clears the run.
    """
    # Staged as given, then without copies: the input is made once, and no task holds it by two hash tables at a time.
    links = stage(stage(links.select("id_curso", F.col("nombre_sesion").cast("string"))).distinct())
    kept = drop_keys(t.tiene_sesion, links, ["id_curso"])
    removed = t.tiene_sesion.join(links.select("id_curso").distinct(), "id_curso", "left_semi").select(*kept.columns)
    named = links.join(session_ids(t, first_only=False), "nombre_sesion")
    new = stage(named.select("id_curso", "id_sesion").distinct())
    return Change({"tiene_sesion": kept.unionByName(new)}, {"tiene_sesion": new}, removed={"tiene_sesion": removed})


def reassign_instructor(t: Tables, changes: DataFrame, order_col: str | None = None, go_on: bool = False) -> Change:
    """Give runs another instructor, by `id_curso` and the full name in `instructor`.

    A run nobody teaches gets no row; a name that is not found changes nothing and is rejected.
    """
    named = changes.withColumnRenamed("instructor", "nombre_completo")
    instructors = stage(instructor_id(t).join(named.select("nombre_completo").distinct(), "nombre_completo", "left_semi"))
    found = named.join(instructors, "nombre_completo").drop("nombre_completo")
    unknown = named.join(instructors, "nombre_completo", "left_anti")
    single, unclear = settled(found, ["id_curso"], order_col, go_on)
    rejected = unknown.withColumnRenamed("nombre_completo", "instructor").select(*changes.columns)
    if unclear is not None:
        of_unclear = named.join(unclear.select("id_curso").distinct(), "id_curso", "left_semi").join(instructors, "nombre_completo", "left_semi")
        rejected = rejected.unionByName(of_unclear.withColumnRenamed("nombre_completo", "instructor").select(*changes.columns))
    return _update(t, "imparte", ["id_curso"], stage(single), _keep_old("id_instructor"), rejected)


def set_registrant_status(t: Tables, changes: DataFrame, order_col: str | None = None, go_on: bool = False) -> Change:
    """Set status and completion of registrants, by run and member; a missing flag means no."""
    values = {c: F.coalesce(f"n_{c}", F.lit(False)) for c in ("status", "curso_aprobado")}
    keys = ["id_curso", "id_usuario"]
    # Staged before and after they are settled: the join with the table then holds no aggregate of changes in memory
    # beside its own rows, and can be split. Flags of no type, which no file can hold, are missing booleans.
    flags = {name: F.col(name).cast("boolean") for name, kind in changes.dtypes if kind == "void"}
    single, rejected = settled(stage(changes.withColumns(flags)), keys, order_col, go_on)
    return _update(t, "registrados_curso", keys, stage(single), values, rejected)

"""Listings and lookups. Without a value to look up, each answers for the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.functions.text import DAY_FIRST, course_label, shown, yes_no
from tertulia.sources.tables import Tables


def where_equal(df: DataFrame, col: str | Column, value: object | None) -> DataFrame:
    column = F.col(col) if isinstance(col, str) else col
    return df if value is None else df.where(column == F.lit(value))


def _first_ids(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """The id a name stands for: the lowest where the name repeats."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(id_col).alias(id_col))


# Listings


def member_listing(t: Tables) -> DataFrame:
    return t.comunidad.select("nombre", "apellido", "correo", "status")


def member_labels(t: Tables) -> DataFrame:
    label = F.concat(shown("nombre"), F.lit(" "), shown("apellido"), F.lit(" : "), shown("correo"))
    return t.comunidad.select("correo", "nombre", "apellido", label.alias("usuario"))


def session_listing(t: Tables) -> DataFrame:
    label = F.concat(F.col("nombre_sesion"), F.lit(" (ID: "), F.col("id_sesion").cast("string"), F.lit(")"))
    return t.sesion.select("id_sesion", "nombre_sesion", label.alias("etiqueta"))


def instructor_listing(t: Tables) -> DataFrame:
    name = F.concat(shown("nombre_instructor"), F.lit(" "), shown("apellido_instructor"))
    return t.instructor.select(
        "id_instructor", "nombre_instructor", "apellido_instructor", name.alias("nombre_completo")
    )


def catalog_listing(t: Tables) -> DataFrame:
    return t.catalogo_cursos.select("nombre_curso")


def course_labels(t: Tables, date_format: str = DAY_FIRST) -> DataFrame:
    """Runs under the label they are chosen by: name and dates, or a note that a date lacks."""
    label = course_label("nombre_curso", "fecha_inicio", "fecha_fin", date_format)
    return t.curso.join(t.catalogo_cursos, "id_catalogo").select(
        "id_curso", "nombre_curso", label.alias("etiqueta")
    )


# Details


def member_details(t: Tables, correo: str | None = None) -> DataFrame:
    return where_equal(t.comunidad, "correo", correo).select(
        "nombre", "apellido", "correo", "status", "negocio", "area", "pais", "baja_empresa"
    )


def session_details(t: Tables, nombre: str | None = None) -> DataFrame:
    return where_equal(t.sesion, "nombre_sesion", nombre).select(
        "nombre_sesion", "fecha_sesion", "link_sesion_informativa"
    )


def course_details(t: Tables, id_curso: int | None = None) -> DataFrame:
    """A run with its course name; `caso_uso` shows the use-case flag as text."""
    run = where_equal(t.curso, "id_curso", id_curso).join(t.catalogo_cursos, "id_catalogo")
    return run.select(
        "id_curso", "nombre_curso", "fecha_inicio", "fecha_fin", "proveedor", "correo_contacto",
        "requiere_caso_uso", yes_no("requiere_caso_uso").alias("caso_uso"),
    )


def course_row(t: Tables, id_curso: int | None = None) -> DataFrame:
    return where_equal(t.curso, "id_curso", id_curso)


def class_attendees(t: Tables, id_clase: int | None = None) -> DataFrame:
    return where_equal(t.asistencia_clase, "id_clase", id_clase).select("id_clase", "id_usuario")


# Names to ids


def session_ids(t: Tables, nombre: str | None = None, first_only: bool = True) -> DataFrame:
    """(nombre_sesion, id_sesion): the lowest id of each name, or every id."""
    named = where_equal(t.sesion, "nombre_sesion", nombre).select("nombre_sesion", "id_sesion")
    return _first_ids(named, "nombre_sesion", "id_sesion") if first_only else named


def catalog_id(t: Tables, nombre: str | None = None) -> DataFrame:
    named = where_equal(t.catalogo_cursos, "nombre_curso", nombre)
    return _first_ids(named, "nombre_curso", "id_catalogo")


def instructor_id(t: Tables, nombre_completo: str | None = None) -> DataFrame:
    """By full name; an instructor with half a name is not found."""
    name = F.concat(F.col("nombre_instructor"), F.lit(" "), F.col("apellido_instructor"))
    named = t.instructor.select(name.alias("nombre_completo"), "id_instructor")
    named = where_equal(named, "nombre_completo", nombre_completo)
    return _first_ids(named, "nombre_completo", "id_instructor")


def runs_of_course(t: Tables, nombre: str | None = None) -> DataFrame:
    course = where_equal(t.catalogo_cursos, "nombre_curso", nombre)
    return t.curso.join(course, "id_catalogo").select("nombre_curso", "id_curso")


def course_by_label(t: Tables, label: str | None = None, date_format: str = DAY_FIRST) -> DataFrame:
    """(etiqueta, id_curso): the lowest id of the runs that share a label."""
    return _first_ids(where_equal(course_labels(t, date_format), "etiqueta", label), "etiqueta", "id_curso")

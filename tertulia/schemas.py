"""The thirteen tables. Ids are surrogate keys handed out on insert."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "BIGINT": T.LongType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[dtype]) for name, dtype in pairs])


SCHEMAS: dict[str, T.StructType] = {
    # entities
    "comunidad": _schema(
        "id_usuario BIGINT, nombre STRING, apellido STRING, correo STRING, status BOOLEAN, "
        "negocio STRING, area STRING, pais STRING, baja_empresa BOOLEAN"
    ),
    "instructor": _schema(
        "id_instructor BIGINT, nombre_instructor STRING, apellido_instructor STRING, "
        "correo_instructor STRING"
    ),
    "catalogo_cursos": _schema("id_catalogo BIGINT, nombre_curso STRING"),
    "curso": _schema(
        "id_curso BIGINT, id_catalogo BIGINT, fecha_inicio DATE, fecha_fin DATE, "
        "proveedor STRING, requiere_caso_uso BOOLEAN, correo_contacto STRING"
    ),
    "sesion": _schema(
        "id_sesion BIGINT, nombre_sesion STRING, fecha_sesion DATE, "
        "link_sesion_informativa STRING"
    ),
    "clase": _schema("id_clase BIGINT, id_curso BIGINT, fecha DATE"),
    # links between entities
    "tiene_sesion": _schema("id_curso BIGINT, id_sesion BIGINT"),
    "imparte": _schema("id_instructor BIGINT, id_curso BIGINT"),
    # participation of members: the large tables
    "invitacion_sesion": _schema("id_sesion BIGINT, id_usuario BIGINT"),
    "asistencia_sesion": _schema("id_sesion BIGINT, id_usuario BIGINT"),
    "invitacion_curso": _schema("id_curso BIGINT, id_usuario BIGINT"),
    "registrados_curso": _schema(
        "id_curso BIGINT, id_usuario BIGINT, status BOOLEAN, solicitud_aprobada BOOLEAN, "
        "curso_aprobado BOOLEAN"
    ),
    "asistencia_clase": _schema("id_clase BIGINT, id_usuario BIGINT"),
}

"""The same queries in SQL for DuckDB, written from what each means rather than how Spark runs it."""

from __future__ import annotations

import re

from tertulia.schemas import SCHEMAS

# White space as Python's strip() sees it, as far as the pasted samples contain any.
BLANK = "concat(' ', chr(9), chr(10), chr(13))"


def _ids(order: str, table: str, id_col: str) -> str:
    """Ids above the highest one, in the order of an MD5 of the row."""
    return f"(SELECT max({id_col}) FROM {table}) + row_number() OVER (ORDER BY md5(concat_ws('|', {order})))"


def _text(*cols: str) -> str:
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)


def _lines(line: str, texts: str = "correos_lineas") -> str:
    return f"""
lineas AS (SELECT id_lote, unnest(string_split(texto, chr(10))) AS linea FROM {texts}),
direcciones AS (
  SELECT DISTINCT id_lote, lower(trim({line}, {BLANK})) AS correo
  FROM lineas WHERE trim(linea, {BLANK}) <> '')"""


NO_CR = "replace(linea, chr(13), '')"
LINES = _lines(NO_CR)
LINES_KEEP_CR = _lines("linea")

PASTED = f"""
entradas AS (SELECT id_lote, unnest(string_split(texto, ';')) AS entrada FROM correos_pegados),
pegados AS (
  SELECT DISTINCT id_lote,
         lower(trim(rtrim(trim(string_split(entrada, '<')[-1], {BLANK}), '>'), {BLANK})) AS correo
  FROM entradas)"""

COURSE_NAMES = """
cursos AS (
  SELECT id_curso, nombre_curso, fecha_inicio, fecha_fin,
         CASE WHEN fecha_inicio IS NULL OR fecha_fin IS NULL
              THEN nombre_curso || ' (Fecha no disponible)'
              ELSE nombre_curso || ' (' || strftime(fecha_inicio, '{style}') || ' - '
                   || strftime(fecha_fin, '{style}') || ')' END AS etiqueta
  FROM curso JOIN catalogo_cursos USING (id_catalogo))"""

# A person is an address with an area; what anyone of that address and area did, they did.
PARTICIPATION = """
hechos AS (
  SELECT 'sesion' AS que, id_sesion AS cual, id_usuario FROM asistencia_sesion WHERE id_sesion IS NOT NULL
  UNION SELECT 'curso', id_curso, id_usuario FROM registrados_curso WHERE id_curso IS NOT NULL),
personas AS (SELECT DISTINCT correo, area FROM comunidad),
de_personas AS (
  SELECT DISTINCT correo, area, que, cual FROM hechos JOIN comunidad USING (id_usuario)),
cuentas AS (
  SELECT p.correo, p.area,
         (SELECT count(*) FROM de_personas d WHERE d.que = 'sesion'
          AND d.correo IS NOT DISTINCT FROM p.correo AND d.area IS NOT DISTINCT FROM p.area) AS sesiones_asistidas,
         (SELECT count(*) FROM de_personas d WHERE d.que = 'curso'
          AND d.correo IS NOT DISTINCT FROM p.correo AND d.area IS NOT DISTINCT FROM p.area) AS cursos_inscritos
  FROM personas p),
participacion AS (
  SELECT correo, coalesce(area, 'Sin área') AS area, sesiones_asistidas, cursos_inscritos,
         sesiones_asistidas + cursos_inscritos AS participacion_total
  FROM cuentas)"""

# Completions are counted once, and once for each session attendance of their member.
ENGAGEMENT = """
miembros AS (SELECT DISTINCT id_usuario FROM comunidad WHERE id_usuario IS NOT NULL),
asistidas AS (SELECT id_usuario, id_sesion FROM asistencia_sesion WHERE id_usuario IN (FROM miembros)),
inscritos AS (SELECT id_usuario, id_curso, curso_aprobado FROM registrados_curso WHERE id_usuario IN (FROM miembros)),
activos AS (
  SELECT id_usuario FROM asistidas WHERE id_sesion IS NOT NULL
  UNION SELECT id_usuario FROM inscritos WHERE id_curso IS NOT NULL),
veces AS (
  SELECT id_usuario, greatest(1, (SELECT count(*) FROM asistidas a WHERE a.id_usuario = m.id_usuario))
         * (SELECT count(*) FROM comunidad c WHERE c.id_usuario = m.id_usuario) AS por_logro
  FROM miembros m),
logros AS (SELECT id_usuario FROM inscritos WHERE curso_aprobado),
metricas AS (
  SELECT total_usuarios, usuarios_participantes, total_usuarios - usuarios_participantes AS usuarios_no_participantes,
         sesiones_asistidas, cursos_inscritos, cursos_completados, cursos_completados_unicos
  FROM (SELECT (SELECT count(*) FROM miembros) AS total_usuarios,
               (SELECT count(*) FROM activos) AS usuarios_participantes,
               (SELECT count(DISTINCT id_sesion) FROM asistidas) AS sesiones_asistidas,
               (SELECT count(DISTINCT id_curso) FROM inscritos) AS cursos_inscritos,
               (SELECT CAST(coalesce(sum(por_logro), 0) AS BIGINT) FROM logros JOIN veces USING (id_usuario))
                 AS cursos_completados,
               (SELECT count(*) FROM logros) AS cursos_completados_unicos))"""


def _labels(style: str) -> str:
    return COURSE_NAMES.format(style=style)


def _roster(table: str, key: str, more: str = "") -> str:
    return f"""SELECT f.{key}, c.nombre, c.apellido, c.correo{more}
FROM comunidad c JOIN {table} f ON c.id_usuario = f.id_usuario"""


def _absent(invited: str, present: str, key: str) -> str:
    """Invitations of people who are not among those present."""
    return f"""SELECT {key}, nombre, apellido, correo FROM {invited} i JOIN comunidad USING (id_usuario)
WHERE NOT EXISTS (FROM {present} a WHERE (a.{key}, a.id_usuario) = (i.{key}, i.id_usuario))"""


def _missed(invited: str, present: str, key: str, about: str, *shown: str) -> str:
    """What members were invited to and have no part in, described by `about`."""
    return f"""WITH presentes AS (SELECT DISTINCT {key}, id_usuario FROM {present}),
faltas AS (SELECT {key}, id_usuario FROM {invited} WHERE ({key}, id_usuario) NOT IN (
  SELECT ({key}, id_usuario) FROM presentes WHERE {key} IS NOT NULL AND id_usuario IS NOT NULL))
SELECT correo, {", ".join(shown)} FROM faltas JOIN comunidad USING (id_usuario) JOIN ({about}) USING ({key})"""


RUNS = "SELECT id_curso, nombre_curso, fecha_inicio, fecha_fin FROM curso NATURAL JOIN catalogo_cursos"
SESSIONS = "SELECT id_sesion, nombre_sesion, fecha_sesion FROM sesion"

# A registration under the name of its course.
BY_NAME = """
nombres AS (SELECT id_curso, nombre_curso FROM curso NATURAL JOIN catalogo_cursos),
registros AS (
  SELECT nombre_curso, id_usuario IS NOT NULL AS contado, coalesce(curso_aprobado, false) AS aprobado
  FROM nombres NATURAL JOIN (SELECT id_curso, id_usuario, curso_aprobado FROM registrados_curso))"""


def _dependents(entity: str, key: str, **links: str) -> str:
    counts = ", ".join(
        f"(SELECT count(*) FROM {table} f WHERE f.{key} = e.{key}) AS {name}" for name, table in links.items()
    )
    return f"SELECT e.{key}, {counts} FROM {entity} e"


def _kept(entity: str, key: str, *links: str) -> str:
    free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {x} f WHERE f.{key} = e.{key})" for x in links)
    return f"SELECT e.* FROM {entity} e WHERE NOT ({free})"


def _blocked(entity: str, key: str, *links: str) -> str:
    return f"SELECT {key} FROM ({_kept(entity, key, *links)})"


def _registered(table: str, key: str, first_only: bool, more: str = "", gate: str = "", lines: str = LINES) -> str:
    member = "min(c.id_usuario)" if first_only else "c.id_usuario"
    group = "GROUP BY d.id_lote, d.correo" if first_only else ""
    return f"""WITH {lines},
pares AS (SELECT DISTINCT {key}, id_usuario FROM (
  SELECT d.id_lote AS {key}, {member} AS id_usuario
  FROM direcciones d JOIN comunidad c ON c.correo = d.correo {gate} {group}))
SELECT * FROM {table}
UNION ALL
SELECT {key}, id_usuario{more} FROM pares p
WHERE NOT EXISTS (SELECT 1 FROM {table} f WHERE f.{key} = p.{key} AND f.id_usuario = p.id_usuario)"""


ALL_KNOWN = """WHERE d.id_lote NOT IN (
    SELECT id_lote FROM direcciones WHERE correo NOT IN (SELECT correo FROM comunidad))"""

MEMBER_LINKS = ("invitacion_curso", "registrados_curso", "invitacion_sesion", "asistencia_sesion")
SESSION_LINKS = ("invitacion_sesion", "asistencia_sesion")
COURSE_LINKS = ("clase", "invitacion_curso", "registrados_curso")

NEW_RUNS = f"""
validos AS (
  SELECT k.id_catalogo, n.* FROM nuevos_cursos n
  JOIN (SELECT nombre_curso, min(id_catalogo) AS id_catalogo FROM catalogo_cursos GROUP BY nombre_curso) k
    ON n.nombre_curso = k.nombre_curso
  WHERE n.nombre_curso <> '' AND n.fecha_inicio IS NOT NULL AND n.fecha_fin IS NOT NULL),
numerados AS (
  SELECT {_ids(
      _text("id_catalogo", "nombre_curso", "fecha_inicio", "fecha_fin", "proveedor", "requiere_caso_uso",
            "correo_contacto") + ", concat('[', array_to_string(sesiones, ', '), ']'), " + _text("instructor"),
      "curso", "id_curso")} AS id_curso, *
  FROM validos)"""

ORACLE: dict[str, str] = {
    # addresses
    "email_lines": f"WITH {LINES} SELECT id_lote, correo FROM direcciones",
    "email_lines_keep_cr": f"WITH {LINES_KEEP_CR} SELECT id_lote, correo FROM direcciones",
    "email_reply_all": f"WITH {PASTED} SELECT id_lote, correo FROM pegados WHERE correo <> ''",
    "known_emails": f"""WITH {PASTED}
SELECT id_lote, correo FROM pegados WHERE correo IN (SELECT correo FROM comunidad)""",
    "unknown_emails": f"""WITH {PASTED}
SELECT id_lote, correo FROM pegados WHERE correo <> '' AND correo NOT IN (SELECT correo FROM comunidad)""",
    "resolve_members": f"""WITH {PASTED}
SELECT id_lote, p.correo, min(id_usuario) AS id_usuario
FROM pegados p JOIN comunidad c ON p.correo = c.correo GROUP BY id_lote, p.correo""",
    # listings and lookups
    "member_listing": "SELECT nombre, apellido, correo, status FROM comunidad",
    "member_labels": """
SELECT correo, nombre, apellido, coalesce(nombre, 'None') || ' ' || coalesce(apellido, 'None') || ' : '
       || coalesce(correo, 'None') AS usuario FROM comunidad""",
    "session_listing": """
SELECT id_sesion, nombre_sesion, nombre_sesion || ' (ID: ' || id_sesion || ')' AS etiqueta FROM sesion""",
    "instructor_listing": """
SELECT id_instructor, nombre_instructor, apellido_instructor,
       nombre_instructor || ' ' || apellido_instructor AS nombre_completo FROM instructor""",
    "catalog_listing": "SELECT nombre_curso FROM catalogo_cursos",
    "member_details": "SELECT * EXCLUDE (id_usuario) FROM comunidad",
    "session_details": "SELECT nombre_sesion, fecha_sesion, link_sesion_informativa FROM sesion",
    "session_ids": "SELECT nombre_sesion, min(id_sesion) AS id_sesion FROM sesion GROUP BY nombre_sesion",
    "course_details": """
SELECT id_curso, nombre_curso, fecha_inicio, fecha_fin, proveedor, correo_contacto, requiere_caso_uso,
       CASE WHEN requiere_caso_uso THEN 'Si' ELSE 'No' END AS caso_uso
FROM curso JOIN catalogo_cursos USING (id_catalogo)""",
    "course_row": "SELECT * FROM curso",
    "catalog_id": """
SELECT nombre_curso, min(id_catalogo) AS id_catalogo FROM catalogo_cursos GROUP BY nombre_curso""",
    "instructor_id": """
SELECT nombre_instructor || ' ' || apellido_instructor AS nombre_completo, min(id_instructor) AS id_instructor
FROM instructor GROUP BY 1""",
    "runs_of_course": "SELECT nombre_curso, id_curso FROM curso JOIN catalogo_cursos USING (id_catalogo)",
    "course_labels": f"WITH {_labels('%d/%m/%Y')} SELECT id_curso, nombre_curso, etiqueta FROM cursos",
    "course_labels_year_first": f"""WITH {_labels('%Y/%m/%d')}
SELECT id_curso, nombre_curso, etiqueta FROM cursos""",
    "course_by_label": f"""WITH {_labels('%d/%m/%Y')}
SELECT etiqueta, min(id_curso) AS id_curso FROM cursos GROUP BY etiqueta""",
    "class_attendees": "SELECT id_clase, id_usuario FROM asistencia_clase",
    # rosters
    "session_invitees": _roster("invitacion_sesion", "id_sesion"),
    "session_attendees": _roster("asistencia_sesion", "id_sesion"),
    "course_invitees": _roster("invitacion_curso", "id_curso"),
    "course_registrants": _roster("registrados_curso", "id_curso"),
    "course_registrant_status": _roster(
        "registrados_curso", "id_curso", ", f.id_usuario, f.status, f.curso_aprobado"
    ),
    "course_classes": """
SELECT u.id_curso, k.id_clase, k.fecha FROM clase k JOIN curso u ON k.id_curso = u.id_curso""",
    "course_sessions": """
SELECT e.id_curso, e.id_sesion, s.nombre_sesion FROM tiene_sesion e JOIN sesion s ON e.id_sesion = s.id_sesion""",
    "member_sessions": f"""SELECT correo, nombre_sesion, fecha_sesion
FROM asistencia_sesion JOIN comunidad USING (id_usuario) JOIN ({SESSIONS}) USING (id_sesion)""",
    "member_courses": f"""SELECT correo, nombre_curso, fecha_inicio, fecha_fin, solicitud_aprobada, curso_aprobado
FROM registrados_curso JOIN ({RUNS}) USING (id_curso) JOIN comunidad USING (id_usuario)""",
    "session_no_shows": _absent("invitacion_sesion", "asistencia_sesion", "id_sesion"),
    "course_not_registered": _absent("invitacion_curso", "registrados_curso", "id_curso"),
    "member_missed_sessions": _missed(
        "invitacion_sesion", "asistencia_sesion", "id_sesion", SESSIONS, "nombre_sesion", "fecha_sesion"
    ),
    "member_missed_courses": _missed(
        "invitacion_curso", "registrados_curso", "id_curso", RUNS, "nombre_curso", "fecha_inicio"
    ),
    # reports
    "session_funnel": f"""WITH
i AS (SELECT id_sesion, count(*) AS n FROM ({_roster("invitacion_sesion", "id_sesion")}) GROUP BY id_sesion),
a AS (SELECT id_sesion, count(*) AS n FROM ({_roster("asistencia_sesion", "id_sesion")}) GROUP BY id_sesion),
x AS (SELECT id_sesion, count(*) AS n
      FROM ({_absent("invitacion_sesion", "asistencia_sesion", "id_sesion")}) GROUP BY id_sesion)
SELECT s.id_sesion, s.nombre_sesion, coalesce(i.n, 0) AS invitados, coalesce(a.n, 0) AS asistentes,
       coalesce(x.n, 0) AS no_asistieron, coalesce(i.n, 0) - coalesce(a.n, 0) AS gap
FROM sesion s LEFT JOIN i ON s.id_sesion = i.id_sesion LEFT JOIN a ON s.id_sesion = a.id_sesion
LEFT JOIN x ON s.id_sesion = x.id_sesion""",
    "course_funnel": f"""WITH
i AS (SELECT id_curso, count(*) AS n FROM ({_roster("invitacion_curso", "id_curso")}) GROUP BY id_curso),
a AS (SELECT id_curso, count(*) AS n FROM ({_roster("registrados_curso", "id_curso")}) GROUP BY id_curso),
x AS (SELECT id_curso, count(*) AS n
      FROM ({_absent("invitacion_curso", "registrados_curso", "id_curso")}) GROUP BY id_curso)
SELECT s.id_curso, k.nombre_curso, coalesce(i.n, 0) AS invitados, coalesce(a.n, 0) AS registrados,
       coalesce(x.n, 0) AS no_registrados, coalesce(i.n, 0) - coalesce(a.n, 0) AS gap
FROM curso s JOIN catalogo_cursos k ON s.id_catalogo = k.id_catalogo
LEFT JOIN i ON s.id_curso = i.id_curso LEFT JOIN a ON s.id_curso = a.id_curso
LEFT JOIN x ON s.id_curso = x.id_curso""",
    "engagement_summary": f"WITH {ENGAGEMENT} SELECT * FROM metricas",
    "engagement_breakdown": f"""WITH {ENGAGEMENT}
SELECT metrica, cantidad FROM (UNPIVOT metricas ON COLUMNS(*) INTO NAME metrica VALUE cantidad)""",
    "top_participants": f"""WITH {PARTICIPATION}
SELECT * FROM participacion ORDER BY participacion_total DESC, correo, area LIMIT 10""",
    "top_participants_area": f"""WITH {PARTICIPATION}
SELECT *, CAST(row_number() OVER (PARTITION BY area ORDER BY participacion_total DESC, correo) AS INTEGER)
  AS puesto
FROM participacion QUALIFY puesto <= 10""",
    "popular_courses": f"""WITH {BY_NAME}
SELECT nombre_curso, count(*) FILTER (contado) AS inscripciones FROM registros
GROUP BY ALL ORDER BY inscripciones DESC, nombre_curso LIMIT 10""",
    "runs_per_course": """
SELECT nombre_curso, CAST(sum(veces) AS BIGINT) AS cantidad_cursos
FROM (SELECT id_catalogo, count(id_curso) AS veces FROM curso GROUP BY id_catalogo) NATURAL JOIN catalogo_cursos
GROUP BY nombre_curso""",
    "completion_rates": f"""WITH {BY_NAME},
totales AS (
  SELECT nombre_curso, count(*) FILTER (contado) AS inscritos, count(*) FILTER (aprobado) AS completados
  FROM registros GROUP BY nombre_curso)
SELECT *, completados / inscritos * 100 AS completion_rate FROM totales""",
    "session_attendance_pct": """WITH
presentes AS (
  SELECT id_sesion, count(*) AS n
  FROM (SELECT DISTINCT id_sesion, id_usuario FROM asistencia_sesion WHERE id_usuario IS NOT NULL) GROUP BY id_sesion),
todos AS (SELECT count(DISTINCT id_usuario) AS total FROM comunidad)
SELECT id_sesion, nombre_sesion, coalesce(n, 0) AS numero_asistentes,
       coalesce(n, 0) / total * 100 AS porcentaje_asistencia
FROM todos, sesion LEFT JOIN presentes USING (id_sesion)""",
    "invite_recommendations": """WITH
nuevos AS (SELECT id_usuario FROM asistencia_sesion WHERE id_usuario IS NOT NULL
           EXCEPT SELECT id_usuario FROM registrados_curso)
SELECT nombre, apellido, correo, count(*) AS sesiones_asistidas
FROM comunidad JOIN asistencia_sesion USING (id_usuario)
WHERE id_usuario IN (FROM nuevos) GROUP BY ALL""",
    "class_attendance": """WITH
fechas AS (SELECT DISTINCT id_curso, fecha FROM clase),
presentes AS (SELECT DISTINCT id_curso, fecha, id_usuario FROM clase NATURAL JOIN asistencia_clase
              WHERE id_usuario IS NOT NULL)
SELECT id_curso, fecha,
       (SELECT count(*) FROM presentes p
        WHERE p.id_curso IS NOT DISTINCT FROM f.id_curso AND p.fecha IS NOT DISTINCT FROM f.fecha) AS numero_asistentes
FROM fechas f""",
    "member_dependents": _dependents(
        "comunidad", "id_usuario", invitaciones_curso="invitacion_curso",
        registros_curso="registrados_curso", invitaciones_sesion="invitacion_sesion",
        asistencias_sesion="asistencia_sesion",
    ),
    "member_dependents_strict": _dependents(
        "comunidad", "id_usuario", invitaciones_curso="invitacion_curso",
        registros_curso="registrados_curso", invitaciones_sesion="invitacion_sesion",
        asistencias_sesion="asistencia_sesion", asistencias_clase="asistencia_clase",
    ),
    "session_dependents": _dependents(
        "sesion", "id_sesion", invitaciones="invitacion_sesion", asistencias="asistencia_sesion"
    ),
    "session_dependents_strict": _dependents(
        "sesion", "id_sesion", invitaciones="invitacion_sesion", asistencias="asistencia_sesion",
        cursos="tiene_sesion",
    ),
    "course_dependents": _dependents(
        "curso", "id_curso", clases="clase", invitaciones="invitacion_curso", registros="registrados_curso"
    ),
    "course_dependents_strict": _dependents(
        "curso", "id_curso", clases="clase", invitaciones="invitacion_curso", registros="registrados_curso",
        sesiones="tiene_sesion", instructores="imparte",
    ),
    # adding
    "add_members": f"""WITH nuevos AS (
  SELECT nullif(nombre, '') AS nombre, nullif(apellido, '') AS apellido, correo, status,
         nullif(nullif(negocio, 'No Registrar'), '') AS negocio,
         nullif(nullif(area, 'No Registrar'), '') AS area, nullif(nullif(pais, 'No Registrar'), '') AS pais,
         CAST(NULL AS BOOLEAN) AS baja_empresa
  FROM nuevos_miembros)
SELECT * FROM comunidad UNION ALL
SELECT {_ids(_text("nombre", "apellido", "correo", "status", "negocio", "area", "pais", "baja_empresa"),
             "comunidad", "id_usuario")}, * FROM nuevos""",
    "add_members_minimal": f"""WITH nuevos AS (
  SELECT nombre, apellido, correo, true AS status, CAST(NULL AS VARCHAR) AS negocio,
         CAST(NULL AS VARCHAR) AS area, CAST(NULL AS VARCHAR) AS pais, CAST(NULL AS BOOLEAN) AS baja_empresa
  FROM miembros_faltantes WHERE nombre <> '' AND apellido <> '')
SELECT * FROM comunidad UNION ALL
SELECT {_ids(_text("nombre", "apellido", "correo", "status", "negocio", "area", "pais", "baja_empresa"),
             "comunidad", "id_usuario")}, * FROM nuevos""",
    "add_members_minimal_rejected": """
SELECT nullif(nombre, '') AS nombre, nullif(apellido, '') AS apellido, correo
FROM miembros_faltantes WHERE coalesce(nombre, '') = '' OR coalesce(apellido, '') = ''""",
    "add_instructors": f"""
SELECT * FROM instructor UNION ALL
SELECT {_ids(_text("nombre_instructor", "apellido_instructor", "correo_instructor"),
             "instructor", "id_instructor")}, *
FROM nuevos_instructores
WHERE nombre_instructor <> '' AND apellido_instructor <> '' AND correo_instructor <> ''""",
    "add_sessions": f"""WITH nuevas AS (
  SELECT nombre_sesion, fecha_sesion, coalesce(link_sesion_informativa, '') AS link_sesion_informativa
  FROM nuevas_sesiones WHERE nombre_sesion <> '' AND fecha_sesion IS NOT NULL)
SELECT * FROM sesion UNION ALL
SELECT {_ids(_text("nombre_sesion", "fecha_sesion", "link_sesion_informativa"), "sesion", "id_sesion")}, *
FROM nuevas""",
    "add_catalog": f"""
SELECT * FROM catalogo_cursos UNION ALL
SELECT {_ids(_text("nombre_curso"), "catalogo_cursos", "id_catalogo")}, nombre_curso
FROM nuevo_catalogo WHERE nombre_curso <> ''""",
    "add_courses": f"""WITH {NEW_RUNS}
SELECT * FROM curso UNION ALL
SELECT id_curso, id_catalogo, fecha_inicio, fecha_fin, proveedor, requiere_caso_uso, correo_contacto
FROM numerados""",
    "add_courses_sessions": f"""WITH {NEW_RUNS},
nombradas AS (SELECT id_curso, unnest(sesiones) AS nombre_sesion FROM numerados),
primeras AS (SELECT nombre_sesion, min(id_sesion) AS id_sesion FROM sesion GROUP BY nombre_sesion)
SELECT * FROM tiene_sesion UNION ALL
SELECT n.id_curso, p.id_sesion FROM nombradas n JOIN primeras p ON n.nombre_sesion = p.nombre_sesion""",
    "add_courses_instructors": f"""WITH {NEW_RUNS}
SELECT * FROM imparte UNION ALL
SELECT i.id_instructor, n.id_curso FROM numerados n
JOIN (SELECT nombre_instructor || ' ' || apellido_instructor AS nombre, min(id_instructor) AS id_instructor
      FROM instructor GROUP BY 1) i ON n.instructor = i.nombre""",
    "add_classes": f"""
SELECT * FROM clase UNION ALL
SELECT {_ids(_text("id_curso", "fecha"), "clase", "id_clase")}, id_curso, fecha FROM nuevas_clases""",
    # registering
    "register_session_invitees": _registered("invitacion_sesion", "id_sesion", False, gate=ALL_KNOWN),
    "register_session_invitees_lenient": _registered("invitacion_sesion", "id_sesion", False),
    "register_session_attendance": _registered("asistencia_sesion", "id_sesion", False),
    "register_course_invitees": _registered("invitacion_curso", "id_curso", True, lines=LINES_KEEP_CR),
    "register_course_registrants": _registered(
        "registrados_curso", "id_curso", True, ", NULL, NULL, NULL", lines=LINES_KEEP_CR
    ),
    "register_class_attendance": f"""WITH {LINES}
SELECT * FROM asistencia_clase UNION ALL
SELECT d.id_lote, min(c.id_usuario) FROM direcciones d JOIN comunidad c ON d.correo = c.correo
GROUP BY d.id_lote, d.correo""",
    "register_class_attendance_dedupe": _registered("asistencia_clase", "id_clase", True),
    # updating
    "update_members": """
SELECT c.id_usuario, coalesce(n.nombre, c.nombre) AS nombre, coalesce(n.apellido, c.apellido) AS apellido,
       coalesce(n.correo_nuevo, c.correo) AS correo, coalesce(n.status, c.status) AS status,
       c.negocio, c.area, c.pais, coalesce(n.baja_empresa, c.baja_empresa) AS baja_empresa
FROM comunidad c LEFT JOIN cambios_comunidad n ON c.correo = n.correo""",
    "update_sessions": """
SELECT s.id_sesion, coalesce(n.nombre_sesion, s.nombre_sesion) AS nombre_sesion,
       coalesce(n.fecha_sesion, s.fecha_sesion) AS fecha_sesion,
       coalesce(n.link_sesion_informativa, s.link_sesion_informativa) AS link_sesion_informativa
FROM sesion s LEFT JOIN cambios_sesion n ON s.id_sesion = n.id_sesion""",
    "update_courses": """
SELECT u.id_curso, u.id_catalogo, coalesce(n.fecha_inicio, u.fecha_inicio) AS fecha_inicio,
       coalesce(n.fecha_fin, u.fecha_fin) AS fecha_fin, coalesce(n.proveedor, u.proveedor) AS proveedor,
       coalesce(n.requiere_caso_uso, u.requiere_caso_uso) AS requiere_caso_uso,
       coalesce(n.correo_contacto, u.correo_contacto) AS correo_contacto
FROM curso u LEFT JOIN cambios_curso n ON u.id_curso = n.id_curso""",
    "replace_course_sessions": """
SELECT id_curso, id_sesion FROM tiene_sesion WHERE id_curso NOT IN (SELECT id_curso FROM enlaces_curso)
UNION ALL
SELECT DISTINCT e.id_curso, s.id_sesion FROM enlaces_curso e JOIN sesion s ON e.nombre_sesion = s.nombre_sesion""",
    "reassign_instructor": """
SELECT coalesce(i.id_instructor, m.id_instructor) AS id_instructor, m.id_curso
FROM imparte m LEFT JOIN cambios_instructor n ON m.id_curso = n.id_curso
LEFT JOIN (SELECT nombre_instructor || ' ' || apellido_instructor AS nombre, min(id_instructor) AS id_instructor
           FROM instructor GROUP BY 1) i ON n.instructor = i.nombre""",
    "reassign_instructor_rejected": """
SELECT id_curso, instructor FROM cambios_instructor
WHERE instructor NOT IN (SELECT nombre_instructor || ' ' || apellido_instructor FROM instructor)""",
    "set_registrant_status": """
SELECT r.id_curso, r.id_usuario,
       CASE WHEN n.id_curso IS NULL THEN r.status ELSE coalesce(n.status, false) END AS status,
       r.solicitud_aprobada,
       CASE WHEN n.id_curso IS NULL THEN r.curso_aprobado ELSE coalesce(n.curso_aprobado, false) END
         AS curso_aprobado
FROM registrados_curso r
LEFT JOIN cambios_registro n ON r.id_curso = n.id_curso AND r.id_usuario = n.id_usuario""",
    # deleting
    "delete_members": _kept("comunidad", "id_usuario", *MEMBER_LINKS),
    "delete_members_blocked": _blocked("comunidad", "id_usuario", *MEMBER_LINKS),
    "delete_sessions": _kept("sesion", "id_sesion", *SESSION_LINKS),
    "delete_sessions_blocked": _blocked("sesion", "id_sesion", *SESSION_LINKS),
    "delete_courses": _kept("curso", "id_curso", *COURSE_LINKS),
    "delete_courses_blocked": _blocked("curso", "id_curso", *COURSE_LINKS),
    "delete_courses_strict": _kept("curso", "id_curso", *COURSE_LINKS, "tiene_sesion", "imparte"),
}

EMAIL = "customer.000000001@example.com"


def _one(name: str, column: str, value: str | int) -> str:
    """The rows of the general query for one value."""
    return f"SELECT * FROM ({ORACLE[name]}) WHERE {column} = {value!r}"


ORACLE |= {
    "top_participants_one_area": f"""WITH {PARTICIPATION}
SELECT * FROM participacion WHERE area = 'IT' ORDER BY participacion_total DESC, correo LIMIT 10""",
    "update_members_changed": f"""
SELECT * FROM ({ORACLE["update_members"]}) WHERE id_usuario IN (
  SELECT id_usuario FROM comunidad WHERE correo IN (SELECT correo FROM cambios_comunidad))""",
    "set_registrant_status_changed": f"""
SELECT * FROM ({ORACLE["set_registrant_status"]})
WHERE (id_curso, id_usuario) IN (SELECT (id_curso, id_usuario) FROM cambios_registro)""",
    "delete_members_removed": f"""
SELECT * FROM comunidad WHERE id_usuario NOT IN (SELECT id_usuario FROM ({ORACLE["delete_members"]}))""",
    "resolve_members_all": f"""WITH {PASTED}
SELECT id_lote, correo, id_usuario FROM pegados JOIN comunidad USING (correo)""",
    "email_reply_all_blank": f"WITH {PASTED} SELECT id_lote, correo FROM pegados",
    "session_ids_all": "SELECT nombre_sesion, id_sesion FROM sesion",
    "member_details_one": _one("member_details", "correo", EMAIL),
    "session_details_one": _one("session_details", "nombre_sesion", "Supplier#000000001"),
    "session_ids_one": _one("session_ids", "nombre_sesion", "Supplier#000000001"),
    "catalog_id_one": _one("catalog_id", "nombre_curso", "Brand#11"),
    "instructor_id_one": _one("instructor_id", "nombre_completo", "NATION_8 EUROPE"),
    "runs_of_course_one": _one("runs_of_course", "nombre_curso", "Brand#11"),
    "course_by_label_one": f"""
SELECT * FROM ({ORACLE["course_by_label"]}) WHERE etiqueta = 'Brand#1 (01/02/2024 - 28/02/2024)'""",
} | {
    f"{name}_one": _one(name, "id_curso", 1)
    for name in (
        "course_details", "course_row", "course_invitees", "course_registrants", "course_registrant_status",
        "course_classes", "course_sessions", "course_not_registered", "course_funnel", "class_attendance",
    )
} | {
    f"{name}_one": _one(name, "id_sesion", 1)
    for name in ("session_invitees", "session_attendees", "session_no_shows", "session_funnel", "session_attendance_pct")
} | {
    f"{name}_one": _one(name, "correo", EMAIL)
    for name in ("member_sessions", "member_courses", "member_missed_sessions", "member_missed_courses")
} | {"class_attendees_one": _one("class_attendees", "id_clase", 1)}


DOUBTFUL = """lotes AS (
  SELECT id_lote + CASE WHEN id_lote % 3 = 0 THEN 500000000 ELSE 0 END AS id_lote, texto FROM correos_lineas),
"""


def _checked(name: str, state: str, key: str, entity: str, lines: str) -> dict[str, str]:
    """Batches of which one in three names no session, run or class: their addresses are all rejected."""
    return {
        f"{name}_checked": state,
        f"{name}_rejected": f"""WITH {lines}
SELECT d.id_lote % 500000000 AS id_lote, d.id_lote AS {key}, correo FROM direcciones d
WHERE d.id_lote NOT IN (SELECT {key} FROM {entity}) OR correo NOT IN (SELECT correo FROM comunidad)""",
    }


def _pairs_checked(name: str, table: str, key: str, entity: str, first_only: bool, more: str = "", gate: str = "WHERE true", line: str = NO_CR) -> dict[str, str]:
    lines = DOUBTFUL + _lines(line, "lotes")
    state = _registered(table, key, first_only, more, f"{gate} AND d.id_lote IN (SELECT {key} FROM {entity})", lines)
    return _checked(name, state, key, entity, lines)


def _in_state(name: str, **states: str) -> str:
    """The SQL of a report with other states in place of some tables."""
    body = ORACLE[name].lstrip()
    for table in states:
        body = re.sub(rf"\b{table}\b", f"{table}_nueva", body)
    ctes = ",\n".join(f"{table}_nueva AS ({sql})" for table, sql in states.items())
    return f"WITH {ctes},\n{body.removeprefix('WITH')}" if body.startswith("WITH") else f"WITH {ctes}\n{body}"


def _of_existing(table: str, key: str, entity: str, first_only: bool, more: str = "", gate: str = "WHERE true", lines: str = LINES) -> str:
    return _registered(table, key, first_only, more, f"{gate} AND d.id_lote IN (SELECT {key} FROM {entity})", lines)


ORACLE |= {
    **_pairs_checked("register_session_invitees", "invitacion_sesion", "id_sesion", "sesion", False, gate=ALL_KNOWN),
    **_pairs_checked("register_session_attendance", "asistencia_sesion", "id_sesion", "sesion", False),
    **_pairs_checked("register_course_invitees", "invitacion_curso", "id_curso", "curso", True, line="linea"),
    **_pairs_checked("register_course_registrants", "registrados_curso", "id_curso", "curso", True, ", NULL, NULL, NULL", line="linea"),
    **_checked(
        "register_class_attendance",
        f"""WITH {DOUBTFUL}{_lines(NO_CR, "lotes")}
SELECT * FROM asistencia_clase UNION ALL
SELECT d.id_lote, min(c.id_usuario) FROM direcciones d JOIN comunidad c ON d.correo = c.correo
WHERE d.id_lote IN (SELECT id_clase FROM clase) GROUP BY d.id_lote, d.correo""",
        "id_clase", "clase", DOUBTFUL + _lines(NO_CR, "lotes"),
    ),
    "upkeep_session_funnel": _in_state(
        "session_funnel",
        invitacion_sesion=_of_existing("invitacion_sesion", "id_sesion", "sesion", False, gate=ALL_KNOWN),
        asistencia_sesion=_of_existing("asistencia_sesion", "id_sesion", "sesion", False),
    ),
    "upkeep_course_funnel": _in_state(
        "course_funnel",
        registrados_curso=_of_existing("registrados_curso", "id_curso", "curso", True, ", NULL, NULL, NULL", lines=LINES_KEEP_CR),
    ),
    "upkeep_completion_rates": _in_state("completion_rates", registrados_curso=ORACLE["set_registrant_status"]),
    "add_members_two_changes": f"""WITH estado AS ({ORACLE["add_members"]}),
nuevos AS (
  SELECT nombre, apellido, correo, true AS status, CAST(NULL AS VARCHAR) AS negocio,
         CAST(NULL AS VARCHAR) AS area, CAST(NULL AS VARCHAR) AS pais, CAST(NULL AS BOOLEAN) AS baja_empresa
  FROM miembros_faltantes WHERE nombre <> '' AND apellido <> '')
SELECT * FROM estado UNION ALL
SELECT {_ids(_text("nombre", "apellido", "correo", "status", "negocio", "area", "pais", "baja_empresa"),
             "estado", "id_usuario")}, * FROM nuevos""",
    "add_classes_checked": f"""WITH buenas AS (
  SELECT id_curso, fecha FROM clases_dudosas WHERE fecha IS NOT NULL AND id_curso IN (SELECT id_curso FROM curso))
SELECT * FROM clase UNION ALL
SELECT {_ids(_text("id_curso", "fecha"), "clase", "id_clase")}, id_curso, fecha FROM buenas""",
    "add_classes_rejected": """
SELECT id_curso, fecha FROM clases_dudosas WHERE fecha IS NULL OR id_curso NOT IN (SELECT id_curso FROM curso)""",
    "email_lines_spread": ORACLE["email_lines"],
    "email_reply_all_spread": ORACLE["email_reply_all"],
    "parsed_dates": """
SELECT id_clase, texto, CAST(coalesce(
         try_strptime(trim(texto), '%Y-%m-%d'), try_strptime(trim(texto), '%Y%m%d'), try_strptime(trim(texto), '%Y-%m-%d %H:%M:%S'),
         try_strptime(trim(texto), '%m/%d/%Y'), try_strptime(trim(texto), '%d/%m/%Y')) AS DATE) AS fecha
FROM fechas_texto""",
    "stored_tables": " UNION ALL ".join(f"SELECT '{name}' AS tabla, count(*) AS filas FROM {name}" for name in SCHEMAS),
    "rewrite_registrant_status": ORACLE["set_registrant_status"],
    "rewrite_delete_members": ORACLE["delete_members"],
    "rewrite_course_sessions": ORACLE["replace_course_sessions"],
    "bucketed_session_invitees": ORACLE["session_invitees"],
    "bucketed_member_dependents": ORACLE["member_dependents"],
    "class_attendance_bitmaps": ORACLE["class_attendance"],
    "class_attendance_stored_bitmaps": ORACLE["class_attendance"],
    "grid_changes": f"""WITH editadas AS (
  SELECT id_curso, id_usuario, id_curso + id_usuario AS n, status, solicitud_aprobada, curso_aprobado,
         CASE WHEN n % 11 = 0 THEN NOT coalesce(status, false) ELSE status END AS s,
         CASE WHEN n % 13 <> 0 THEN curso_aprobado END AS c FROM registrados_curso)
SELECT id_curso, id_usuario, CASE WHEN status IS DISTINCT FROM s THEN s END AS status,
       CASE WHEN curso_aprobado IS DISTINCT FROM c THEN c END AS curso_aprobado,
       concat_ws(',', CASE WHEN status IS DISTINCT FROM s THEN 'status' END,
                 CASE WHEN curso_aprobado IS DISTINCT FROM c THEN 'curso_aprobado' END) AS columnas, 'cambia' AS que
FROM editadas WHERE n % 17 <> 0 AND (status IS DISTINCT FROM s OR curso_aprobado IS DISTINCT FROM c)
UNION ALL SELECT id_curso, id_usuario, status, curso_aprobado, NULL, 'falta' FROM editadas WHERE n % 17 = 0
UNION ALL SELECT id_curso + 500000000, id_usuario, s, c, NULL, 'dudosa' FROM editadas WHERE n % 17 <> 0 AND id_curso = 2 AND id_usuario % 2 = 0""",
    "grid_set_registrant_status": """
SELECT id_curso, id_usuario,
       CASE WHEN cambia THEN coalesce(CASE WHEN n % 11 = 0 THEN NOT coalesce(status, false) ELSE status END, false) ELSE status END AS status,
       solicitud_aprobada,
       CASE WHEN cambia THEN coalesce(CASE WHEN n % 13 <> 0 THEN curso_aprobado END, false) ELSE curso_aprobado END AS curso_aprobado
FROM (SELECT *, id_curso + id_usuario AS n,
             n % 17 <> 0 AND (n % 11 = 0 OR (n % 13 = 0 AND curso_aprobado IS NOT NULL)) AS cambia FROM registrados_curso)""",
    "append_class_attendance_twice": ORACLE["register_class_attendance"],
    "add_courses_written_again": f"""SELECT * FROM ({ORACLE["add_courses"]}) JOIN ({ORACLE["add_courses_sessions"]}) USING (id_curso)""",
    "period_attendance": """
SELECT id_sesion, nombre_sesion, fecha_sesion,
       (SELECT count(DISTINCT a.id_usuario) FROM asistencia_sesion a WHERE a.id_sesion = s.id_sesion) AS numero_asistentes
FROM sesion s WHERE fecha_sesion BETWEEN DATE '2024-03-01' AND DATE '2024-05-31'""",
}
TORN = """repetidos AS (
  SELECT * FROM cambios_curso UNION ALL
  SELECT * REPLACE ('Otro proveedor' AS proveedor) FROM cambios_curso WHERE id_curso % 5 = 0 UNION ALL
  SELECT * FROM cambios_curso WHERE id_curso % 7 = 0),
claros AS (SELECT DISTINCT * FROM repetidos WHERE id_curso % 5 <> 0)"""
ORACLE["update_courses_go_on"] = f"WITH {TORN}\n" + ORACLE["update_courses"].replace("cambios_curso", "claros")
ORACLE["update_courses_unclear"] = f"WITH {TORN}\nSELECT * FROM repetidos WHERE id_curso % 5 = 0"
ORACLE["period_attendance_by_month"] = ORACLE["period_attendance"]

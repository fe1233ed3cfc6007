"""The community's tables, derived from the test tables by SQL that Spark and DuckDB both accept.

The filters in the participation views shape the data: they decide who takes part, so that there
are members, sessions and runs of every kind to report on; some runs have no session, and some are
left out of a change by a rule on their id. Queries run over these tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tertulia.schemas import SCHEMAS
from tertulia.sources.tables import Tables

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

TABLES: dict[str, str] = {
    # Members; those after UNION ALL have no activity.
    "comunidad": """
SELECT c_custkey AS id_usuario,
       CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_mktsegment END AS nombre,
       substr(c_name, 10) AS apellido,
       concat(lower(replace(c_name, '#', '.')), '@example.com') AS correo,
       c_acctbal >= 0 AS status, c_mktsegment AS negocio,
       CASE c_nationkey % 6 WHEN 0 THEN 'IT' WHEN 1 THEN 'Recursos Humanos' WHEN 2 THEN 'Logística'
            WHEN 3 THEN 'Administración' WHEN 4 THEN 'Comercial' END AS area,
       n_name AS pais, c_acctbal < 0 AS baja_empresa
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT CAST(1000000 + n_nationkey AS BIGINT), NULL, NULL,
       concat('idle.', lower(n_name), '@example.com'), false, NULL, NULL, n_name, NULL
FROM nation""",
    "instructor": """
SELECT CAST(n_nationkey AS BIGINT) AS id_instructor, n_name AS nombre_instructor,
       r_name AS apellido_instructor, concat(lower(n_name), '@example.com') AS correo_instructor
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "catalogo_cursos": """
SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id_catalogo, p_brand AS nombre_curso FROM part""",
    # Runs; those after UNION ALL have no classes, invitations or registrations.
    "curso": """
SELECT p_partkey AS id_curso, CAST(substr(p_brand, 7) AS BIGINT) AS id_catalogo,
       CASE WHEN p_size = 1 THEN NULL
            ELSE CAST(concat('2024-', lpad(CAST(1 + p_size % 12 AS VARCHAR(2)), 2, '0'), '-01') AS DATE)
       END AS fecha_inicio,
       CASE WHEN p_size = 2 THEN NULL
            ELSE CAST(concat('2024-', lpad(CAST(1 + p_size % 12 AS VARCHAR(2)), 2, '0'), '-28') AS DATE)
       END AS fecha_fin,
       p_type AS proveedor, p_size > 25 AS requiere_caso_uso,
       concat(lower(p_type), '@example.com') AS correo_contacto
FROM part
UNION ALL
SELECT CAST(1000000 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS DATE), CAST(NULL AS DATE),
       r_name, false, concat(lower(r_name), '@example.com')
FROM region""",
    # Sessions; those after UNION ALL have no invitations or attendance.
    "sesion": """
SELECT s_suppkey AS id_sesion, s_name AS nombre_sesion,
       CAST(concat('2024-', lpad(CAST(1 + s_nationkey % 12 AS VARCHAR(2)), 2, '0'), '-15') AS DATE)
         AS fecha_sesion,
       CASE WHEN s_acctbal > 5000 THEN concat('https://example.com/', CAST(s_suppkey AS VARCHAR(20))) END
         AS link_sesion_informativa
FROM supplier
UNION ALL
SELECT CAST(1000000 + r_regionkey AS BIGINT), r_name, CAST('2024-12-31' AS DATE), NULL FROM region""",
    "clase": """
SELECT l_orderkey AS id_clase, id_curso, CAST(o_orderdate AS DATE) AS fecha
FROM (SELECT l_orderkey, min(l_partkey) AS id_curso FROM lineitem GROUP BY l_orderkey) AS lineas
JOIN orders ON l_orderkey = o_orderkey""",
    "tiene_sesion": """
SELECT DISTINCT l_partkey AS id_curso, l_suppkey AS id_sesion FROM lineitem WHERE l_partkey % 10 <> 7""",
    "imparte": """
SELECT p_partkey % 25 AS id_instructor, p_partkey AS id_curso FROM part""",
    "invitacion_sesion": """
SELECT DISTINCT l_suppkey AS id_sesion, o_custkey AS id_usuario
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount < 0.08""",
    "asistencia_sesion": """
SELECT DISTINCT l_suppkey AS id_sesion, o_custkey AS id_usuario
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_linestatus = 'F' AND o_custkey % 7 <> 0 AND l_suppkey % 10 <> 3""",
    "invitacion_curso": """
SELECT DISTINCT l_partkey AS id_curso, o_custkey AS id_usuario
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount < 0.08""",
    "registrados_curso": """
SELECT l_partkey AS id_curso, o_custkey AS id_usuario, max(l_tax) >= 0.01 AS status,
       max(l_quantity) > 10 AS solicitud_aprobada, max(l_returnflag) = 'R' AS curso_aprobado
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey % 3 <> 0 AND l_returnflag <> 'N' GROUP BY l_partkey, o_custkey""",
    "asistencia_clase": """
SELECT l_orderkey AS id_clase, l_suppkey AS id_usuario FROM lineitem
UNION ALL
SELECT l_orderkey AS id_clase, l_suppkey AS id_usuario FROM lineitem WHERE l_linenumber = 1""",
}

INPUTS: dict[str, str] = {
    # Pasted texts, one per 25 neighbouring members, so that no cell grows with the table.
    "correos_pegados": """
SELECT CAST((c_custkey - c_custkey % 25) / 25 AS BIGINT) AS id_lote,
       string_agg(concat(c_mktsegment, ' <',
                         CASE WHEN c_custkey % 4 = 0 THEN concat('New.', c_name)
                              ELSE replace(c_name, '#', '.') END, '@Example.com>'), '; ') AS texto
FROM customer GROUP BY CAST((c_custkey - c_custkey % 25) / 25 AS BIGINT)""",
    # One address per line, with white space, carriage returns inside and around, repeats in capitals
    # and blank lines; about one text in four names an address that is not a member's.
    "correos_lineas": """
SELECT CAST((c_custkey - c_custkey % 25) / 25 AS BIGINT) AS id_lote,
       string_agg(concat(chr(9), replace(c_name, '#', CASE WHEN c_custkey % 100 = 0 THEN '-' ELSE '.' END),
                         CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('@Exam', chr(13), 'ple.com ', chr(13))
                              ELSE concat('@Example.com ', chr(13)) END,
                         CASE WHEN c_nationkey = 5
                              THEN concat(chr(10), upper(replace(c_name, '#', '.')), '@EXAMPLE.COM')
                              ELSE '' END,
                         CASE WHEN c_acctbal < 0 THEN concat(chr(10), ' ') ELSE '' END), chr(10)) AS texto
FROM customer GROUP BY CAST((c_custkey - c_custkey % 25) / 25 AS BIGINT)""",
    "nuevos_miembros": """
SELECT CASE WHEN s_acctbal < 1000 THEN '' ELSE s_name END AS nombre, n_name AS apellido,
       concat(lower(replace(s_name, '#', '.')), '@example.com') AS correo, s_acctbal > 0 AS status,
       CASE s_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'No Registrar' ELSE 'Ventas' END AS negocio,
       CASE WHEN s_acctbal > 5000 THEN 'No Registrar' ELSE 'IT' END AS area, n_name AS pais
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "miembros_faltantes": """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS nombre,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE substr(c_name, 10) END AS apellido,
       concat('nuevo.', lower(replace(c_name, '#', '.')), '@example.com') AS correo
FROM customer""",
    "nuevos_instructores": """
SELECT CASE WHEN s_acctbal < 1000 THEN '' ELSE s_name END AS nombre_instructor,
       n_name AS apellido_instructor,
       concat(lower(replace(s_name, '#', '.')), '@example.com') AS correo_instructor
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "nuevas_sesiones": """
SELECT CASE WHEN p_size = 1 THEN '' ELSE concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) END
         AS nombre_sesion,
       CASE WHEN p_size = 2 THEN NULL ELSE CAST('2025-02-01' AS DATE) END AS fecha_sesion,
       CASE WHEN p_size > 25 THEN concat('https://example.com/', CAST(p_partkey AS VARCHAR(20))) END
         AS link_sesion_informativa
FROM part""",
    "nuevo_catalogo": """
SELECT DISTINCT CASE WHEN p_size = 1 THEN '' ELSE p_name END AS nombre_curso FROM part""",
    "nuevos_cursos": """
SELECT CASE WHEN p_size = 3 THEN 'Sin catálogo' ELSE p_brand END AS nombre_curso,
       CASE WHEN p_size = 1 THEN NULL ELSE CAST('2025-03-01' AS DATE) END AS fecha_inicio,
       CAST('2025-03-28' AS DATE) AS fecha_fin, p_name AS proveedor, p_size > 25 AS requiere_caso_uso,
       concat('curso.', CAST(p_partkey AS VARCHAR(20)), '@example.com') AS correo_contacto,
       split(concat('Supplier#', lpad(CAST(1 + p_size % 10 AS VARCHAR(9)), 9, '0'), ';', r_name, ';', p_type), ';')
         AS sesiones,
       concat(n_name, ' ', r_name) AS instructor
FROM part JOIN nation ON p_size % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "nuevas_clases": """
SELECT l_partkey AS id_curso, CAST(l_shipdate AS DATE) AS fecha
FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE)""",
    # Runs of which one in four does not exist.
    "clases_dudosas": """
SELECT l_partkey + CASE WHEN l_partkey % 4 = 0 THEN 500000000 ELSE 0 END AS id_curso,
       CASE WHEN l_partkey % 10 = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS fecha
FROM lineitem GROUP BY 1, 2""",
    # Dates as people write them: in several forms, some of which are none.
    "fechas_texto": """
SELECT o_orderkey AS id_clase,
       CASE o_orderkey % 7
         WHEN 0 THEN dia
         WHEN 1 THEN concat(substr(dia, 9, 2), '/', substr(dia, 6, 2), '/', substr(dia, 1, 4))
         WHEN 2 THEN concat(' ', substr(dia, 6, 2), '/', substr(dia, 9, 2), '/', substr(dia, 1, 4), ' ')
         WHEN 3 THEN concat(substr(dia, 1, 4), substr(dia, 6, 2), substr(dia, 9, 2))
         WHEN 4 THEN concat(dia, ' 10:30:00')
         WHEN 5 THEN concat(substr(dia, 1, 4), '-31-', substr(dia, 9, 2)) END AS texto
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS dia FROM orders) AS pedidos""",
    "cambios_comunidad": """
SELECT concat(lower(replace(c_name, '#', '.')), '@example.com') AS correo,
       CASE WHEN c_acctbal > 5000 THEN c_name END AS nombre,
       CASE WHEN c_acctbal < 1000 THEN 'Apellido nuevo' END AS apellido,
       CASE WHEN c_mktsegment = 'MACHINERY'
            THEN concat('alta.', lower(replace(c_name, '#', '.')), '@example.com') END AS correo_nuevo,
       c_acctbal > 2000 AS status, 'Ventas' AS negocio,
       CASE WHEN c_acctbal > 0 THEN c_acctbal > 9000 END AS baja_empresa
FROM customer""",
    "cambios_sesion": """
SELECT s_suppkey AS id_sesion, CASE WHEN s_acctbal > 3000 THEN concat('Sesión ', s_name) END AS nombre_sesion,
       CASE WHEN s_acctbal > 6000 THEN CAST('2025-01-31' AS DATE) END AS fecha_sesion,
       CASE WHEN s_acctbal < 1000 THEN '' END AS link_sesion_informativa
FROM supplier""",
    "cambios_curso": """
SELECT p_partkey AS id_curso, CASE WHEN p_size < 10 THEN CAST('2025-04-01' AS DATE) END AS fecha_inicio,
       CASE WHEN p_size > 40 THEN CAST('2025-04-30' AS DATE) END AS fecha_fin,
       CASE WHEN p_size = 7 THEN p_name END AS proveedor,
       CASE WHEN p_size < 30 THEN p_size > 20 END AS requiere_caso_uso,
       CASE WHEN p_size > 20 THEN 'contacto@example.com' END AS correo_contacto
FROM part""",
    "enlaces_curso": """
SELECT DISTINCT l_partkey AS id_curso, s_name AS nombre_sesion
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 10 <> 3
UNION ALL
SELECT DISTINCT p_partkey AS id_curso, NULL AS nombre_sesion FROM part WHERE p_size > 45""",
    "cambios_instructor": """
SELECT p_partkey AS id_curso,
       CASE WHEN p_size = 3 THEN 'Nadie' ELSE concat(n_name, ' ', r_name) END AS instructor
FROM part JOIN nation ON p_size % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "cambios_registro": """
SELECT l_partkey AS id_curso, o_custkey AS id_usuario,
       CASE WHEN max(l_quantity) > 45 THEN NULL ELSE max(l_quantity) > 25 END AS status,
       max(l_discount) > 0.05 AS curso_aprobado
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 10 <> 1
GROUP BY l_partkey, o_custkey""",
}

VIEWS = {**TABLES, **INPUTS}


def _reads(sql: str) -> list[str]:
    return re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)


class Samples:
    """The derived tables in `tables`, and the inputs of changes by name.

    `stored` is a folder that holds the inputs as written before, which are then read from there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Tables | None = None, stored: str | None = None):
        self.spark = spark
        self._sf_dir = sf_dir
        self._stored = stored
        self._raw: set[str] = set()
        self.tables = tables or Tables(self.view)

    def view(self, name: str) -> DataFrame:
        if self._stored and name in INPUTS:
            return self.spark.read.parquet(f"{self._stored}/{name}")
        for table in _reads(VIEWS[name]):
            if table in RAW and table not in self._raw:
                self.spark.read.parquet(f"{self._sf_dir}/{table}.parquet").createOrReplaceTempView(table)
                self._raw.add(table)
        return self.spark.sql(VIEWS[name])


def with_views(body: str) -> str:
    """`body` with the views it reads in front of it, for an engine that has only the raw tables."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    if not used:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if re.match(r"\s*WITH\s", body):
        return f"WITH {views},\n" + re.sub(r"\s*WITH\s", "", body, count=1)
    return f"WITH {views}\n{body}"


assert set(TABLES) == set(SCHEMAS)

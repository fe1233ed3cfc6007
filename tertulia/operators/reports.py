"""Reports over the whole community.

Facts are counted per member, session or run before they are joined, so two facts of one member
never multiply each other and a popular key shrinks to one row per map task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.functions.text import NO_AREA
from tertulia.operators.lookups import where_equal
from tertulia.plans.bitmaps import bitmaps, count_ids, merge, words
from tertulia.plans.joins import count_links, without_match, zero_if_null
from tertulia.sources.layouts import MONTH, month_of
from tertulia.sources.tables import Tables

TOP = 10
SESSION, COURSE = 1, 2  # where a row of several tables in one comes from


def _sum_if(flag: str) -> Column:
    return F.sum(F.when(F.col(flag), 1).otherwise(0).cast("long"))


def _percent(part: str | Column, whole: str | Column) -> Column:
    """Null, not an error, when there is nothing to divide by."""
    return F.try_divide(part, whole) * 100


# Invitations against attendance or registration


def _funnel(t: Tables, invited: DataFrame, present: DataFrame, key: str, names: tuple[str, str, str]):
    """Per `key`: invited, present, their difference, and the invited who are not present.

    One pass over both tables collapses each (key, member) pair; only pairs of known members count.
    """
    marks = invited.select(key, "id_usuario", F.lit(1).alias("_i"), F.lit(0).alias("_p")).unionByName(
        present.select(key, "id_usuario", F.lit(0).alias("_i"), F.lit(1).alias("_p"))
    )
    pairs = marks.groupBy(key, "id_usuario").agg(F.sum("_i").alias("_i"), F.sum("_p").alias("_p"))
    return _funnel_of(t, pairs, key, names)


def _funnel_of(t: Tables, pairs: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """The funnel from how often each (key, member) pair is invited and present, `_i` and `_p`."""
    invitado, presente, ausente = names
    known = pairs.join(t.comunidad.select("id_usuario"), "id_usuario", "left_semi")
    return known.groupBy(key).agg(
        F.sum("_i").alias(invitado),
        F.sum("_p").alias(presente),
        F.sum(F.when(F.col("_p") == 0, F.col("_i")).otherwise(0)).alias(ausente),
    )


def session_funnel(t: Tables, id_sesion: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Invited and attended per session. `gap` is the difference of the counts; people also come
    uninvited, so `no_asistieron` counts the invited who stayed away.

    `pairs` are stored counts that `upkeep.SESSION_PAIRS` keeps; the tables of invitations and attendance are
    not read then."""
    names = ("invitados", "asistentes", "no_asistieron")
    if pairs is None:
        facts = (where_equal(x, "id_sesion", id_sesion) for x in (t.invitacion_sesion, t.asistencia_sesion))
        counts = _funnel(t, *facts, "id_sesion", names)
    else:
        counts = _funnel_of(t, where_equal(pairs, "id_sesion", id_sesion), "id_sesion", names)
    sessions = where_equal(t.sesion, "id_sesion", id_sesion).select("id_sesion", "nombre_sesion")
    return sessions.join(counts, "id_sesion", "left").select(
        "id_sesion", "nombre_sesion", *zero_if_null("invitados", "asistentes", "no_asistieron"),
        F.coalesce(F.col("invitados") - F.col("asistentes"), F.lit(0).cast("long")).alias("gap"),
    )


def course_funnel(t: Tables, id_curso: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Invited and registered per course run; columns as in `session_funnel`, `pairs` as `upkeep.COURSE_PAIRS` keeps."""
    names = ("invitados", "registrados", "no_registrados")
    if pairs is None:
        facts = (where_equal(x, "id_curso", id_curso) for x in (t.invitacion_curso, t.registrados_curso))
        counts = _funnel(t, *facts, "id_curso", names)
    else:
        counts = _funnel_of(t, where_equal(pairs, "id_curso", id_curso), "id_curso", names)
    runs = where_equal(t.curso, "id_curso", id_curso).join(t.catalogo_cursos, "id_catalogo")
    return runs.join(counts, "id_curso", "left").select(
        "id_curso", "nombre_curso", *zero_if_null("invitados", "registrados", "no_registrados"),
        F.coalesce(F.col("invitados") - F.col("registrados"), F.lit(0).cast("long")).alias("gap"),
    )


# Engagement


def engagement_summary(t: Tables) -> DataFrame:
    """One row on the whole community.

    `cursos_completados` counts a completed registration once per session its member attended,
    as joining both facts to the member does; `cursos_completados_unicos` counts it once.

    Each fact is cut to known members once, by a semi join that both the counts per member and the
    distinct sessions or runs read. Both read the same columns, so that Spark shuffles them once. A
    member with a large share of the rows is split where spark.sql.adaptive.forceOptimizeSkewedJoin is on.
    """
    members = t.comunidad.where("id_usuario IS NOT NULL").select("id_usuario")
    attended = t.asistencia_sesion.select("id_usuario", "id_sesion").join(members, "id_usuario", "left_semi")
    registered = t.registrados_curso.select(
        "id_usuario", "id_curso", F.when(F.col("curso_aprobado"), 1).otherwise(0).cast("long").alias("_completo")
    ).join(members, "id_usuario", "left_semi")

    per_member = (
        members.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("_filas"))
        .join(
            attended.groupBy("id_usuario").agg(
                F.count(F.lit(1)).alias("_asistencias"), F.count("id_sesion").alias("_sesiones")
            ),
            "id_usuario", "left",
        )
        .join(
            registered.groupBy("id_usuario").agg(
                F.count("id_curso").alias("_cursos"), F.sum("_completo").alias("_completados")
            ),
            "id_usuario", "left",
        )
    )
    active = F.coalesce(F.col("_sesiones") > 0, F.lit(False)) | F.coalesce(F.col("_cursos") > 0, F.lit(False))
    per_session = F.col("_completados") * F.greatest(F.coalesce("_asistencias", F.lit(1)), F.lit(1)) * F.col("_filas")
    summary = per_member.agg(
        F.count(F.lit(1)).alias("total_usuarios"),
        F.count(F.when(active, 1)).alias("usuarios_participantes"),
        F.coalesce(F.sum(per_session), F.lit(0)).alias("cursos_completados"),
    )
    runs = registered.groupBy("id_curso").agg(F.sum("_completo").alias("_completados"))
    of_runs = runs.agg(F.struct(F.count("id_curso").alias("n"), F.coalesce(F.sum("_completados"), F.lit(0)).alias("c"))).scalar()
    return summary.withColumn("_runs", of_runs).select(
        "total_usuarios",
        "usuarios_participantes",
        (F.col("total_usuarios") - F.col("usuarios_participantes")).alias("usuarios_no_participantes"),
        attended.agg(F.countDistinct("id_sesion")).scalar().alias("sesiones_asistidas"),
        F.col("_runs.n").alias("cursos_inscritos"),
        "cursos_completados",
        F.col("_runs.c").alias("cursos_completados_unicos"),
    )


def engagement_breakdown(t: Tables) -> DataFrame:
    """The summary as rows of (metrica, cantidad)."""
    summary = engagement_summary(t)
    return summary.unpivot([], summary.columns, "metrica", "cantidad")


def _participation(t: Tables, area: str | None) -> DataFrame:
    """Distinct sessions and runs per person; a person is an address and area, nearly always one
    member.

    Links are made distinct and counted per member. People of one member take these counts; only for
    people of several are the distinct links counted again, which reuses their shuffle. Everything is
    one plan, so all of it sees the tables at one time. With an area, the facts are cut to its members
    before they are shuffled.
    """
    shown_area = F.coalesce(F.col("area"), F.lit(NO_AREA))
    person = Window.partitionBy("correo", "area")
    members = where_equal(t.comunidad.select("id_usuario", "correo", "area"), shown_area, area)
    people = members.withColumn("_rep", F.min("id_usuario").over(person)).withColumn(
        "_twins", F.min("id_usuario").over(person) < F.max("id_usuario").over(person)
    )

    def links(df: DataFrame, key: str, source: int) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).select("id_usuario", F.lit(source).alias("_de"), F.col(key).alias("_id"))
        return rows if area is None else rows.join(members.select("id_usuario"), "id_usuario", "left_semi")

    def counted(rows: DataFrame, key: str) -> DataFrame:
        sessions = F.count(F.when(F.col("_de") == SESSION, 1)).alias("sesiones_asistidas")
        return rows.groupBy(key).agg(sessions, F.count(F.when(F.col("_de") == COURSE, 1)).alias("cursos_inscritos"))

    # Distinct on all three columns, so that a very active person is spread over the tasks.
    both = links(t.asistencia_sesion, "id_sesion", SESSION).unionByName(
        links(t.registrados_curso, "id_curso", COURSE)
    ).distinct()
    single = people.where(~F.coalesce("_twins", F.lit(False))).select("id_usuario", "correo", "area").distinct()
    of_single = single.join(counted(both, "id_usuario"), "id_usuario", "left")
    twins = people.where("_twins").select("id_usuario", "_rep", "correo", "area")
    of_twins = both.join(twins.select("id_usuario", "_rep"), "id_usuario").select("_rep", "_de", "_id").distinct()
    shared = twins.select("_rep", "correo", "area").distinct().join(counted(of_twins, "_rep"), "_rep", "left")
    figures = ["sesiones_asistidas", "cursos_inscritos"]
    found = of_single.select("correo", "area", *figures).unionByName(shared.select("correo", "area", *figures))
    shown = found.select("correo", shown_area.alias("area"), *zero_if_null(*figures))
    total = F.col("sesiones_asistidas") + F.col("cursos_inscritos")
    return shown.withColumn("participacion_total", total)


def top_participants(t: Tables, n: int = TOP, area: str | None = None) -> DataFrame:
    """The `n` most involved members, of one area if given; ties go by address."""
    ranked = _participation(t, area).orderBy(F.desc("participacion_total"), "correo", "area")
    return ranked.limit(n)


def top_participants_by_area(t: Tables, n: int = TOP) -> DataFrame:
    """The `n` most involved members of every area. Spark keeps `n` rows of an area per map task
    before the shuffle, so a large area does not meet in one task."""
    order = Window.partitionBy("area").orderBy(F.desc("participacion_total"), "correo")
    ranked = _participation(t, None).withColumn("puesto", F.row_number().over(order))
    return ranked.where(F.col("puesto") <= n)


def invite_recommendations(t: Tables) -> DataFrame:
    """Members who attended a session and never registered for a course, most active first."""
    candidates = without_match(t.asistencia_sesion, t.registrados_curso, ["id_usuario"])
    people = t.comunidad.select("id_usuario", "nombre", "apellido", "correo")
    counted = (
        candidates.join(people, "id_usuario")
        .groupBy("nombre", "apellido", "correo")
        .agg(F.sum("copias").alias("sesiones_asistidas"))
    )
    return counted.orderBy(F.desc("sesiones_asistidas"), "correo", "nombre", "apellido")


# Courses


def _per_course(t: Tables, counts: DataFrame, *totals: str) -> DataFrame:
    """Counts per run, summed per course name."""
    named = counts.join(t.curso.select("id_curso", "id_catalogo"), "id_curso")
    sums = [F.sum(c).alias(c) for c in totals]
    per_entry = named.groupBy("id_catalogo").agg(*sums)
    return per_entry.join(t.catalogo_cursos, "id_catalogo").groupBy("nombre_curso").agg(*sums)


def popular_courses(t: Tables, n: int = TOP) -> DataFrame:
    counts = t.registrados_curso.groupBy("id_curso").agg(F.count("id_usuario").alias("inscripciones"))
    ranked = _per_course(t, counts, "inscripciones").orderBy(F.desc("inscripciones"), "nombre_curso")
    return ranked.limit(n)


def runs_per_course(t: Tables) -> DataFrame:
    counts = t.curso.groupBy("id_catalogo").agg(F.count("id_curso").alias("cantidad_cursos"))
    named = counts.join(t.catalogo_cursos, "id_catalogo")
    return named.groupBy("nombre_curso").agg(F.sum("cantidad_cursos").alias("cantidad_cursos"))


def completion_rates(t: Tables, results: DataFrame | None = None) -> DataFrame:
    """Registered, completed and their percentage per course, most registered first.

    `results` are stored counts per run that `upkeep.RUN_RESULTS` keeps; registrations are not read then."""
    counts = results
    if counts is None:
        counts = t.registrados_curso.groupBy("id_curso").agg(
            F.count("id_usuario").alias("inscritos"), _sum_if("curso_aprobado").alias("completados")
        )
    rates = _per_course(t, counts, "inscritos", "completados").withColumn(
        "completion_rate", _percent("completados", "inscritos")
    )
    return rates.orderBy(F.desc("inscritos"), "nombre_curso")


# Attendance


def session_attendance_pct(t: Tables, id_sesion: int | None = None) -> DataFrame:
    """Distinct attendees of each session, and what percentage of all members they are.

    They are counted by bitmaps, each filled where the pairs of a session and 32,768 member ids are dealt to, so that no
    bitmap is moved, sorted or kept, however few of its bits are set."""
    attended = where_equal(t.asistencia_sesion, "id_sesion", id_sesion)
    counts = count_ids(bitmaps(attended, ["id_sesion"], "id_usuario"), ["id_sesion"], "numero_asistentes")
    members = t.comunidad.agg(F.countDistinct("id_usuario")).scalar()
    sessions = where_equal(t.sesion, "id_sesion", id_sesion).select("id_sesion", "nombre_sesion")
    counted = sessions.join(counts, "id_sesion", "left").select(
        "id_sesion", "nombre_sesion", *zero_if_null("numero_asistentes")
    )
    return counted.withColumn("porcentaje_asistencia", _percent("numero_asistentes", members))


def class_attendance(t: Tables, id_curso: int | None = None, by_bitmap: bool = False) -> DataFrame:
    """Distinct attendees per run and class date, by date; classes on one date count as one.

    Every class adds a row without an attendee, so that dates nobody attended count zero. The
    join of the two large tables is thus an inner one, which adaptive execution splits on either
    side when a class is very popular.

    `by_bitmap` counts attendees by bitmaps, filled where the rows of a date and 32,768 member ids are dealt to: one
    bitmap at a time is held, however many attended. The other way counts distinct pairs.
    """
    classes = where_equal(t.clase, "id_curso", id_curso)
    attended = t.asistencia_clase.join(classes, "id_clase").select("id_curso", "fecha", "id_usuario")
    held = classes.select("id_curso", "fecha", F.lit(None).cast("long").alias("id_usuario"))
    rows, keys, name = attended.unionByName(held), ["id_curso", "fecha"], "numero_asistentes"
    if by_bitmap:
        counts = count_ids(bitmaps(rows, keys, "id_usuario"), keys, name)
    else:
        counts = rows.groupBy(*keys).agg(F.countDistinct("id_usuario").alias(name))
    return counts.orderBy("id_curso", "fecha")


def attendance_bitmaps(t: Tables) -> DataFrame:
    """Who attended each class, as bitmaps to store: id_clase, _bucket and _bits. New attendance is merged into them
    without reading the old."""
    return words(t.asistencia_clase, ["id_clase"], "id_usuario")


def class_attendance_of(t: Tables, maps: DataFrame) -> DataFrame:
    """`class_attendance` from stored bitmaps of the classes, merged from class to date."""
    dated = maps.join(t.clase, "id_clase").select("id_curso", "fecha", "_bucket", "_bits")
    keys = ["id_curso", "fecha"]
    counts = count_ids(merge(dated, keys), keys, "_n")
    dates = t.clase.select(*keys, F.lit(0).cast("long").alias("_n"))
    both = counts.unionByName(dates).groupBy(*keys).agg(F.max("_n").alias("numero_asistentes"))
    return both.orderBy(*keys)


def period_attendance(t: Tables, first: date, last: date, by_month: DataFrame | None = None) -> DataFrame:
    """Distinct attendees of each session from `first` to `last`, sessions without any included.

    `by_month` is the attendance as `layouts.write_by_month` stores it; then only the folders of months in which there
    are such sessions are read. The months come from the sessions as the query finds them, so any
    filter on sessions prunes the attendance.
    """
    sessions = t.sesion.where(F.col("fecha_sesion").between(first, last)).select("id_sesion", "nombre_sesion", "fecha_sesion")
    if by_month is None:
        attended = t.asistencia_sesion.join(sessions.select("id_sesion"), "id_sesion", "left_semi")
    else:
        months = sessions.select("id_sesion", month_of("fecha_sesion").alias(MONTH))
        attended = by_month.join(months, ["id_sesion", MONTH], "left_semi")
    counts = attended.groupBy("id_sesion").agg(F.countDistinct("id_usuario").alias("numero_asistentes"))
    return sessions.join(counts, "id_sesion", "left").select(
        "id_sesion", "nombre_sesion", "fecha_sesion", *zero_if_null("numero_asistentes")
    )


# What depends on a member, session or run


def member_links(t: Tables, strict: bool = False) -> dict[str, tuple[DataFrame, str]]:
    links = {
        "invitaciones_curso": (t.invitacion_curso, "id_usuario"),
        "registros_curso": (t.registrados_curso, "id_usuario"),
        "invitaciones_sesion": (t.invitacion_sesion, "id_usuario"),
        "asistencias_sesion": (t.asistencia_sesion, "id_usuario"),
    }
    return links | {"asistencias_clase": (t.asistencia_clase, "id_usuario")} if strict else links


def session_links(t: Tables, strict: bool = False) -> dict[str, tuple[DataFrame, str]]:
    links = {
        "invitaciones": (t.invitacion_sesion, "id_sesion"),
        "asistencias": (t.asistencia_sesion, "id_sesion"),
    }
    return links | {"cursos": (t.tiene_sesion, "id_sesion")} if strict else links


def course_links(t: Tables, strict: bool = False) -> dict[str, tuple[DataFrame, str]]:
    links = {
        "clases": (t.clase, "id_curso"),
        "invitaciones": (t.invitacion_curso, "id_curso"),
        "registros": (t.registrados_curso, "id_curso"),
    }
    more = {"sesiones": (t.tiene_sesion, "id_curso"), "instructores": (t.imparte, "id_curso")}
    return links | more if strict else links


def member_dependents(t: Tables, strict: bool = False) -> DataFrame:
    """Rows that refer to each member. `strict` also counts class attendance."""
    return count_links(t.comunidad, member_links(t, strict), "id_usuario")


def member_dependents_stored(t: Tables, strict: bool = False) -> DataFrame:
    """`member_dependents` from tables that are in buckets by member (`layouts.write_buckets`): each is counted where it
    lies and joined by member, so nothing is shuffled. Tables in no buckets are counted with less by the other form."""
    links = member_links(t, strict)
    members = t.comunidad.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("_filas"))
    for name, (df, key) in links.items():
        members = members.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return members.select("id_usuario", *zero_if_null(*links))


def session_dependents(t: Tables, strict: bool = False) -> DataFrame:
    """Rows that refer to each session. `strict` also counts links to runs."""
    return count_links(t.sesion, session_links(t, strict), "id_sesion")


def course_dependents(t: Tables, strict: bool = False) -> DataFrame:
    """Rows that refer to each run. `strict` also counts links to sessions and instructors."""
    return count_links(t.curso, course_links(t, strict), "id_curso")

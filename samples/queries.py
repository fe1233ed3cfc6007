"""Every report and change on the sample tables. Changes return a table as they leave it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samples import stored
from samples.stored import PERIOD
from samples.views import Samples
from tertulia.functions.text import YEAR_FIRST, parse_date
from tertulia.operators import adds, deletes, emails, lookups, registrations, reports, rosters, updates

Query = Callable[[Samples], DataFrame]


def _report(function: Callable[..., DataFrame], **options) -> Query:
    return lambda s: function(s.tables, **options)


def _after(function: Callable, table: str, rows: str, **options) -> Query:
    """The new state of `table`."""
    return lambda s: function(s.tables, s.view(rows), **options).tables[table]


def _rejected(function: Callable, rows: str, **options) -> Query:
    return lambda s: function(s.tables, s.view(rows), **options).rejected


def _batches(s: Samples, key: str) -> DataFrame:
    return s.view("correos_lineas").selectExpr("id_lote", f"id_lote AS {key}", "texto")


def _registered(function: Callable, table: str, key: str, **options) -> Query:
    """Batches for whatever id, before the rows they refer to are there."""
    return lambda s: function(s.tables, _batches(s, key), must_exist=False, **options).tables[table]


def _deleted(function: Callable, table: str, key: str, **options) -> Query:
    return lambda s: function(s.tables, getattr(s.tables, table).select(key), **options).tables[table]


def _blocked(function: Callable, table: str, key: str, **options) -> Query:
    return lambda s: function(s.tables, getattr(s.tables, table).select(key), **options).rejected


def _pasted(s: Samples) -> DataFrame:
    return emails.parse_reply_all(s.view("correos_pegados"))


QUERIES: dict[str, Query] = {
    # addresses
    "email_lines": lambda s: emails.parse_email_lines(s.view("correos_lineas")),
    "email_lines_keep_cr": lambda s: emails.parse_email_lines(s.view("correos_lineas"), drop_cr=False),
    "email_reply_all": _pasted,
    "known_emails": lambda s: emails.known_emails(s.tables, _pasted(s)),
    "unknown_emails": lambda s: emails.unknown_emails(s.tables, _pasted(s)),
    "resolve_members": lambda s: emails.resolve_members(s.tables, _pasted(s)),
    # listings and lookups
    "member_listing": _report(lookups.member_listing),
    "member_labels": _report(lookups.member_labels),
    "session_listing": _report(lookups.session_listing),
    "instructor_listing": _report(lookups.instructor_listing),
    "catalog_listing": _report(lookups.catalog_listing),
    "member_details": _report(lookups.member_details),
    "session_details": _report(lookups.session_details),
    "session_ids": _report(lookups.session_ids),
    "course_details": _report(lookups.course_details),
    "course_row": _report(lookups.course_row),
    "catalog_id": _report(lookups.catalog_id),
    "instructor_id": _report(lookups.instructor_id),
    "runs_of_course": _report(lookups.runs_of_course),
    "course_labels": _report(lookups.course_labels),
    "course_labels_year_first": _report(lookups.course_labels, date_format=YEAR_FIRST),
    "course_by_label": _report(lookups.course_by_label),
    "class_attendees": _report(lookups.class_attendees),
    # rosters
    "session_invitees": _report(rosters.session_invitees),
    "session_attendees": _report(rosters.session_attendees),
    "course_invitees": _report(rosters.course_invitees),
    "course_registrants": _report(rosters.course_registrants),
    "course_registrant_status": _report(rosters.course_registrants, with_status=True),
    "course_classes": _report(rosters.course_classes),
    "course_sessions": _report(rosters.course_sessions),
    "member_sessions": _report(rosters.member_sessions),
    "member_courses": _report(rosters.member_courses),
    "session_no_shows": _report(rosters.session_no_shows),
    "course_not_registered": _report(rosters.course_not_registered),
    "member_missed_sessions": _report(rosters.member_missed_sessions),
    "member_missed_courses": _report(rosters.member_missed_courses),
    # reports
    "session_funnel": _report(reports.session_funnel),
    "course_funnel": _report(reports.course_funnel),
    "engagement_summary": _report(reports.engagement_summary),
    "engagement_breakdown": _report(reports.engagement_breakdown),
    "top_participants": _report(reports.top_participants),
    "top_participants_area": _report(reports.top_participants_by_area),
    "popular_courses": _report(reports.popular_courses),
    "runs_per_course": _report(reports.runs_per_course),
    "completion_rates": _report(reports.completion_rates),
    "session_attendance_pct": _report(reports.session_attendance_pct),
    "invite_recommendations": _report(reports.invite_recommendations),
    "class_attendance": _report(reports.class_attendance),
    "member_dependents": _report(reports.member_dependents),
    "session_dependents": _report(reports.session_dependents),
    "course_dependents": _report(reports.course_dependents),
    "member_dependents_strict": _report(reports.member_dependents, strict=True),
    "session_dependents_strict": _report(reports.session_dependents, strict=True),
    "course_dependents_strict": _report(reports.course_dependents, strict=True),
    # adding
    "add_members": _after(adds.add_members, "comunidad", "nuevos_miembros"),
    "add_members_minimal": _after(adds.add_members_minimal, "comunidad", "miembros_faltantes"),
    "add_members_minimal_rejected": _rejected(adds.add_members_minimal, "miembros_faltantes"),
    "add_instructors": _after(adds.add_instructors, "instructor", "nuevos_instructores"),
    "add_sessions": _after(adds.add_sessions, "sesion", "nuevas_sesiones"),
    "add_catalog": _after(adds.add_catalog, "catalogo_cursos", "nuevo_catalogo"),
    "add_courses": _after(adds.add_courses, "curso", "nuevos_cursos"),
    "add_courses_sessions": _after(adds.add_courses, "tiene_sesion", "nuevos_cursos"),
    "add_courses_instructors": _after(adds.add_courses, "imparte", "nuevos_cursos"),
    "add_classes": _after(adds.add_classes, "clase", "nuevas_clases", must_exist=False),
    # registering
    "register_session_invitees": _registered(
        registrations.register_session_invitees, "invitacion_sesion", "id_sesion"
    ),
    "register_session_invitees_lenient": _registered(
        registrations.register_session_invitees, "invitacion_sesion", "id_sesion", strict=False
    ),
    "register_session_attendance": _registered(
        registrations.register_session_attendance, "asistencia_sesion", "id_sesion"
    ),
    "register_course_invitees": _registered(
        registrations.register_course_invitees, "invitacion_curso", "id_curso"
    ),
    "register_course_registrants": _registered(
        registrations.register_course_registrants, "registrados_curso", "id_curso"
    ),
    "register_class_attendance": _registered(
        registrations.register_class_attendance, "asistencia_clase", "id_clase"
    ),
    "register_class_attendance_dedupe": _registered(
        registrations.register_class_attendance, "asistencia_clase", "id_clase", dedupe=True
    ),
    # updating
    "update_members": _after(updates.update_members, "comunidad", "cambios_comunidad"),
    "update_sessions": _after(updates.update_sessions, "sesion", "cambios_sesion"),
    "update_courses": _after(updates.update_courses, "curso", "cambios_curso"),
    "replace_course_sessions": _after(updates.replace_course_sessions, "tiene_sesion", "enlaces_curso"),
    "reassign_instructor": _after(updates.reassign_instructor, "imparte", "cambios_instructor"),
    "reassign_instructor_rejected": _rejected(updates.reassign_instructor, "cambios_instructor"),
    "set_registrant_status": _after(updates.set_registrant_status, "registrados_curso", "cambios_registro"),
    # deleting
    "delete_members": _deleted(deletes.delete_members, "comunidad", "id_usuario"),
    "delete_members_blocked": _blocked(deletes.delete_members, "comunidad", "id_usuario"),
    "delete_sessions": _deleted(deletes.delete_sessions, "sesion", "id_sesion"),
    "delete_sessions_blocked": _blocked(deletes.delete_sessions, "sesion", "id_sesion"),
    "delete_courses": _deleted(deletes.delete_courses, "curso", "id_curso"),
    "delete_courses_blocked": _blocked(deletes.delete_courses, "curso", "id_curso"),
    "delete_courses_strict": _deleted(deletes.delete_courses, "curso", "id_curso", strict=True),
}

EMAIL = "customer.000000001@example.com"
ONE_RUN, ONE_SESSION, ONE_MEMBER = {"id_curso": 1}, {"id_sesion": 1}, {"correo": EMAIL}

# The forms for one value, as a person asks for them.
QUERIES |= {
    "top_participants_one_area": _report(reports.top_participants, area="IT"),
    "member_details_one": _report(lookups.member_details, **ONE_MEMBER),
    "session_details_one": _report(lookups.session_details, nombre="Supplier#000000001"),
    "session_ids_one": _report(lookups.session_ids, nombre="Supplier#000000001"),
    "session_ids_all": _report(lookups.session_ids, first_only=False),
    "catalog_id_one": _report(lookups.catalog_id, nombre="Brand#11"),
    "instructor_id_one": _report(lookups.instructor_id, nombre_completo="NATION_8 EUROPE"),
    "runs_of_course_one": _report(lookups.runs_of_course, nombre="Brand#11"),
    "course_by_label_one": _report(lookups.course_by_label, label="Brand#1 (01/02/2024 - 28/02/2024)"),
    "course_details_one": _report(lookups.course_details, **ONE_RUN),
    "course_row_one": _report(lookups.course_row, **ONE_RUN),
    "class_attendees_one": _report(lookups.class_attendees, id_clase=1),
    "session_invitees_one": _report(rosters.session_invitees, **ONE_SESSION),
    "session_attendees_one": _report(rosters.session_attendees, **ONE_SESSION),
    "session_no_shows_one": _report(rosters.session_no_shows, **ONE_SESSION),
    "course_invitees_one": _report(rosters.course_invitees, **ONE_RUN),
    "course_registrants_one": _report(rosters.course_registrants, **ONE_RUN),
    "course_registrant_status_one": _report(rosters.course_registrants, with_status=True, **ONE_RUN),
    "course_classes_one": _report(rosters.course_classes, **ONE_RUN),
    "course_sessions_one": _report(rosters.course_sessions, **ONE_RUN),
    "course_not_registered_one": _report(rosters.course_not_registered, **ONE_RUN),
    "member_sessions_one": _report(rosters.member_sessions, **ONE_MEMBER),
    "member_courses_one": _report(rosters.member_courses, **ONE_MEMBER),
    "member_missed_sessions_one": _report(rosters.member_missed_sessions, **ONE_MEMBER),
    "member_missed_courses_one": _report(rosters.member_missed_courses, **ONE_MEMBER),
    "session_funnel_one": _report(reports.session_funnel, **ONE_SESSION),
    "course_funnel_one": _report(reports.course_funnel, **ONE_RUN),
    "session_attendance_pct_one": _report(reports.session_attendance_pct, **ONE_SESSION),
    "class_attendance_one": _report(reports.class_attendance, **ONE_RUN),
    "email_reply_all_blank": lambda s: emails.parse_reply_all(s.view("correos_pegados"), keep_blank=True),
    "resolve_members_all": lambda s: emails.resolve_members(s.tables, _pasted(s), first_only=False),
    "update_members_changed": lambda s: _changed(s, updates.update_members, "comunidad", "cambios_comunidad"),
    "set_registrant_status_changed": lambda s: _changed(
        s, updates.set_registrant_status, "registrados_curso", "cambios_registro"
    ),
    "delete_members_removed": lambda s: deletes.delete_members(
        s.tables, s.tables.comunidad.select("id_usuario")
    ).removed["comunidad"],
}


# Batches of which one in three names a session, run or class that does not exist.
def _doubtful(s: Samples, key: str) -> DataFrame:
    return s.view("correos_lineas").selectExpr(
        "id_lote", f"id_lote + CASE WHEN id_lote % 3 = 0 THEN 500000000 ELSE 0 END AS {key}", "texto"
    )


def _checked(function: Callable, table: str, key: str, **options) -> dict[str, Query]:
    name = function.__name__
    return {
        f"{name}_checked": lambda s: function(s.tables, _doubtful(s, key), **options).tables[table],
        f"{name}_rejected": lambda s: function(s.tables, _doubtful(s, key), **options).rejected,
    }


def _torn(s: Samples) -> DataFrame:
    """Changes of runs, one run in five with two that differ, and one in seven with the same one twice."""
    changes = s.view("cambios_curso")
    other = changes.where("id_curso % 5 = 0").withColumn("proveedor", F.lit("Otro proveedor"))
    return changes.unionByName(other).unionByName(changes.where("id_curso % 7 = 0"))


QUERIES |= {
    "update_courses_go_on": lambda s: updates.update_courses(s.tables, _torn(s), go_on=True).tables["curso"],
    "update_courses_unclear": lambda s: updates.update_courses(s.tables, _torn(s), go_on=True).rejected,
    "add_classes_checked": _after(adds.add_classes, "clase", "clases_dudosas"),
    "add_classes_rejected": _rejected(adds.add_classes, "clases_dudosas"),
    **_checked(registrations.register_session_invitees, "invitacion_sesion", "id_sesion"),
    **_checked(registrations.register_session_attendance, "asistencia_sesion", "id_sesion"),
    **_checked(registrations.register_course_invitees, "invitacion_curso", "id_curso"),
    **_checked(registrations.register_course_registrants, "registrados_curso", "id_curso"),
    **_checked(registrations.register_class_attendance, "asistencia_clase", "id_clase"),
    "email_lines_spread": lambda s: emails.parse_email_lines(s.view("correos_lineas"), spread=True),
    "email_reply_all_spread": lambda s: emails.parse_reply_all(s.view("correos_pegados"), spread=True),
    "parsed_dates": lambda s: s.view("fechas_texto").withColumn("fecha", parse_date("texto")),
    "stored_tables": stored.table_sizes,
    "rewrite_registrant_status": stored.rewritten_status,
    "rewrite_delete_members": stored.rewritten_members,
    "rewrite_course_sessions": stored.rewritten_links,
    "bucketed_session_invitees": stored.bucketed_invitees,
    "bucketed_member_dependents": stored.bucketed_dependents,
    "period_attendance": _report(reports.period_attendance, first=PERIOD[0], last=PERIOD[1]),
    "period_attendance_by_month": stored.attendance_by_month,
    "class_attendance_bitmaps": _report(reports.class_attendance, by_bitmap=True),
    "class_attendance_stored_bitmaps": stored.attendance_from_bitmaps,
    "upkeep_session_funnel": stored.kept_session_funnel,
    "upkeep_course_funnel": stored.kept_course_funnel,
    "upkeep_completion_rates": stored.kept_completion_rates,
    "grid_changes": stored.edited_cells,
    "grid_set_registrant_status": stored.edited_status,
    "add_members_two_changes": stored.two_changes,
    "add_courses_written_again": stored.written_again,
    "append_class_attendance_twice": stored.appended_twice,
}


def _changed(s: Samples, function: Callable, table: str, rows: str) -> DataFrame:
    return function(s.tables, s.view(rows)).changed[table]


def bound(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Samples(spark, sf_dir))

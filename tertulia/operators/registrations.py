"""Registering pasted addresses with a session, a course run or a class.

`batches` holds one row per pasted text: the id of the session, run or class, the text, and any
further columns that tell submissions apart. Calling one of these twice adds nothing the second
time, except for class attendance without `dedupe`.

Batches for a session, run or class that does not exist register nobody, and all their addresses are
rejected; `must_exist=False` takes any id, for batches that come ahead of the rows they refer to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.operators.emails import parse_email_lines, resolve_members, unknown_emails
from tertulia.plans.joins import drop_keys, new_pairs, split_known
from tertulia.plans.staging import stage
from tertulia.sources.tables import Change, Tables


def _added(t: Tables, table: str, pairs: DataFrame, rejected: DataFrame) -> Change:
    current = getattr(t, table)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in current.schema if f.name not in pairs.columns]
    rows = pairs.select(*pairs.columns, *missing).select(*current.columns)
    return Change({table: current.unionByName(rows)}, {table: rows}, rejected)


def _pairs(t: Tables, emails: DataFrame, key: str, first_only: bool) -> DataFrame:
    resolved = resolve_members(t, emails, first_only=first_only).select(key, "id_usuario")
    return stage(resolved.distinct())


def _read(
    t: Tables, batches: DataFrame, entity: DataFrame, key: str, must_exist: bool, drop_cr: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Addresses of the batches to be registered, those of them that no member has, and all that is
    rejected: these, and every address of a batch whose session, run or class does not exist."""
    if not must_exist:
        emails = parse_email_lines(batches, drop_cr=drop_cr)
        unknown = unknown_emails(t, emails)
        return emails, unknown, unknown
    known, lost = split_known(batches, entity, key)
    emails = parse_email_lines(known, drop_cr=drop_cr)
    unknown = unknown_emails(t, emails)
    return emails, unknown, unknown.unionByName(parse_email_lines(lost, drop_cr=drop_cr))


def register_session_invitees(t: Tables, batches: DataFrame, strict: bool = True, must_exist: bool = True) -> Change:
    """Invite to sessions. With `strict`, a batch that names an unknown address adds nobody;
    the unknown addresses are the rejected rows either way."""
    emails, unknown, rejected = _read(t, batches, t.sesion, "id_sesion", must_exist)
    accepted = emails
    if strict:
        batch = [c for c in emails.columns if c != "correo"]
        accepted = drop_keys(emails, unknown, batch)
    pairs = _pairs(t, accepted, "id_sesion", first_only=False)
    return _added(t, "invitacion_sesion", new_pairs(pairs, t.invitacion_sesion), rejected)


def register_session_attendance(t: Tables, batches: DataFrame, must_exist: bool = True) -> Change:
    emails, _, rejected = _read(t, batches, t.sesion, "id_sesion", must_exist)
    pairs = _pairs(t, emails, "id_sesion", first_only=False)
    return _added(t, "asistencia_sesion", new_pairs(pairs, t.asistencia_sesion), rejected)


def _register_course(t: Tables, table: str, batches: DataFrame, must_exist: bool) -> Change:
    emails, _, rejected = _read(t, batches, t.curso, "id_curso", must_exist, drop_cr=False)
    pairs = _pairs(t, emails, "id_curso", first_only=True)
    return _added(t, table, new_pairs(pairs, getattr(t, table)), rejected)


def register_course_invitees(t: Tables, batches: DataFrame, must_exist: bool = True) -> Change:
    return _register_course(t, "invitacion_curso", batches, must_exist)


def register_course_registrants(t: Tables, batches: DataFrame, must_exist: bool = True) -> Change:
    """Register for course runs; status, approval and completion start out missing."""
    return _register_course(t, "registrados_curso", batches, must_exist)


def register_class_attendance(t: Tables, batches: DataFrame, dedupe: bool = False, must_exist: bool = True) -> Change:
    """Record class attendance, once per address of a batch. Pairs already there are recorded
    again unless `dedupe`."""
    emails, _, rejected = _read(t, batches, t.clase, "id_clase", must_exist)
    resolved = resolve_members(t, emails).select("id_clase", "id_usuario")
    # Staged where pairs repeat: which rows are added must not hang on when the tables are read.
    pairs = new_pairs(stage(resolved.distinct()), t.asistencia_clase) if dedupe else stage(resolved)
    return _added(t, "asistencia_clase", pairs, rejected)

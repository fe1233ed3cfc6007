"""Deleting what nothing depends on. Check and change read the same snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tertulia.operators.reports import course_links, member_links, session_links
from tertulia.plans.joins import linked_keys
from tertulia.sources.tables import Change, Tables


def _delete(
    t: Tables, table: str, key: str, ids: DataFrame, links: Mapping[str, tuple[DataFrame, str]]
) -> Change:
    """`table` without the ids that no link names; the ids that one names are rejected.

    Links are reduced to distinct keys before they are shuffled. For a short list of ids Catalyst
    moves the semi join below that, and the large tables are only scanned.
    """
    wanted = ids.select(key).distinct()
    blocked = linked_keys([df for df, _ in links.values()], key).join(wanted, key, "left_semi")
    free = wanted.join(blocked, key, "left_anti")
    current = getattr(t, table)
    kept, removed = (current.join(free, key, how).select(*current.columns) for how in ("left_anti", "left_semi"))
    return Change({table: kept}, rejected=blocked, removed={table: removed})


def delete_members(t: Tables, ids: DataFrame, strict: bool = False) -> Change:
    """Delete members without invitations, registrations or session attendance; `strict` also
    spares those who attended a class."""
    return _delete(t, "comunidad", "id_usuario", ids, member_links(t, strict))


def delete_sessions(t: Tables, ids: DataFrame, strict: bool = False) -> Change:
    """Delete sessions nobody was invited to or attended; `strict` also spares those a run uses."""
    return _delete(t, "sesion", "id_sesion", ids, session_links(t, strict))


def delete_courses(t: Tables, ids: DataFrame, strict: bool = False) -> Change:
    """Delete runs without classes, invitations or registrations; `strict` also spares those
    linked to a session or an instructor."""
    return _delete(t, "curso", "id_curso", ids, course_links(t, strict))

"""Stored counts that are brought up to date from what a change adds and takes away.

A count per key is a sum over rows, so a change moves it by the rows it adds less the rows it removes,
with the old form of changed rows among the latter. The large tables behind the counts are not read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.sources.tables import Change, Tables


@dataclass(frozen=True, eq=False)
class Tally:
    """Sums per key over the rows of several tables.

    keys    columns the sums go by
    terms   for each sum, the table it is over and the value a row adds, an SQL expression
    """

    keys: tuple[str, ...]
    terms: Mapping[str, tuple[str, str]]

    def _over(self, table: str, rows: DataFrame, sign: int) -> DataFrame:
        def value(name: str) -> Column:
            of, what = self.terms[name]
            return (F.expr(f"cast({what} as long)") * sign if of == table else F.lit(0).cast("long")).alias(name)

        return rows.select(*self.keys, *[value(n) for n in self.terms])

    def _summed(self, parts: Sequence[DataFrame]) -> DataFrame:
        sums = [F.sum(n).alias(n) for n in self.terms]
        return reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(*sums)

    def tables(self) -> list[str]:
        return sorted({table for table, _ in self.terms.values()})

    def count(self, t: Tables) -> DataFrame:
        """The sums from the tables themselves: what to store first."""
        return self._summed([self._over(name, getattr(t, name), 1) for name in self.tables()])

    def delta(self, change: Change) -> DataFrame | None:
        """How a change moves the sums; None if it touches none of the tables."""
        signed = ((change.added, 1), (change.changed, 1), (change.removed, -1), (change.replaced, -1))
        parts = [self._over(name, rows[name], sign) for rows, sign in signed for name in self.tables() if name in rows]
        return self._summed(parts) if parts else None

    def bring_up(self, stored: DataFrame, change: Change) -> DataFrame:
        """The stored sums as they are after a change; keys that no row is left for are dropped.

        Store the result under a new path, or in parts by key (`sources.parts`) with `moved`.
        """
        delta = self.delta(change)
        if delta is None:
            return stored
        rows = [stored.select(*self.keys, *self.terms), delta]
        return self._summed(rows).where(" OR ".join(f"{n} <> 0" for n in self.terms))

    def moved(self, stored: DataFrame, change: Change, table: str) -> Change:
        """The same as a change of the stored sums alone, for a writer that replaces the keys it touches."""
        delta = self.delta(change)
        if delta is None:
            return Change({table: stored})
        old = stored.join(delta.select(*self.keys), list(self.keys), "left_semi")
        new = self._summed([old.select(*self.keys, *self.terms), delta]).where(" OR ".join(f"{n} <> 0" for n in self.terms))
        return Change({}, changed={table: new}, removed={table: old})


#: Invitations and attendance of each session and member, and the like for runs: what the funnels follow from.
SESSION_PAIRS = Tally(("id_sesion", "id_usuario"), {"_i": ("invitacion_sesion", "1"), "_p": ("asistencia_sesion", "1")})
COURSE_PAIRS = Tally(("id_curso", "id_usuario"), {"_i": ("invitacion_curso", "1"), "_p": ("registrados_curso", "1")})
#: Registrations and completions of each run: what completion rates and popular courses follow from.
RUN_RESULTS = Tally(
    ("id_curso",),
    {
        "inscritos": ("registrados_curso", "CASE WHEN id_usuario IS NOT NULL THEN 1 ELSE 0 END"),
        "completados": ("registrados_curso", "CASE WHEN curso_aprobado THEN 1 ELSE 0 END"),
    },
)

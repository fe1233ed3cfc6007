"""Reading the community's tables, and the state a change leaves behind."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from tertulia.functions.text import parse_date
from tertulia.schemas import SCHEMAS

PARTICIPATION = ("invitacion_sesion", "asistencia_sesion", "invitacion_curso", "registrados_curso", "asistencia_clase")
PARTITIONED = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}


@dataclass(frozen=True)
class Change:
    """Outcome of a table change; nothing is written until a sink is called.

    tables    the new state of every table touched
    added     the new rows alone: append these rather than rewriting a large table
    changed   the rows of an update alone, as they become
    replaced  the same rows as they were
    removed   the rows that a change takes away
    rejected  input rows that were not applied

    New rows are settled when the change is made. `tables` is for further work before anything is
    written; after a write, `Tables.reload` reads the state from the table itself.
    """

    tables: Mapping[str, DataFrame]
    added: Mapping[str, DataFrame] = field(default_factory=dict)
    rejected: DataFrame | None = None
    changed: Mapping[str, DataFrame] = field(default_factory=dict)
    removed: Mapping[str, DataFrame] = field(default_factory=dict)
    replaced: Mapping[str, DataFrame] = field(default_factory=dict)


class Tables:
    """The tables as attributes, each read on first use."""

    def __init__(self, read: Callable[[str], DataFrame], known: Mapping[str, DataFrame] | None = None):
        self._read = read
        self._known = dict(known or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._read(name)
        return self._known[name]

    def with_tables(self, **changed: DataFrame) -> Tables:
        return Tables(self._read, {**self._known, **changed})

    def apply(self, change: Change) -> Tables:
        """The state that `change` leads to, before it is written."""
        return self.with_tables(**change.tables)

    def as_views(self, prefix: str = "") -> None:
        """Register the tables as temporary views, for SQL; a table's columns are then as declared."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")

    def reload(self, *names: str) -> Tables:
        """Read the named tables anew, all without a name, as after a write."""
        return Tables(self._read, {k: v for k, v in self._known.items() if names and k not in names})


def load_tables(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    table_options: Mapping[str, Mapping[str, str]] | None = None,
    paths: Mapping[str, str] | None = None,
) -> Tables:
    """Open the tables.

    fmt="table"  `location` is a catalog and schema, e.g. "lab.community"
    fmt="jdbc"   `location` is the URL; give large tables partitionColumn, lowerBound,
                 upperBound and numPartitions in `table_options`, or one task reads each
    otherwise    a file format; `location` is the folder that holds one folder per table

    `paths` names another path for single tables, such as a newer snapshot. Tables that bring their
    own column names and types, as those of a warehouse do, are cast to the declared ones; text
    is read as a date in any of the usual forms (`functions.text.DATE_FORMATS`) or becomes a missing date, anything
    else that does not fit is an error. Participation
    tables are not read over JDBC without partition options, as one task would read each.
    """
    options = dict(options or {})
    table_options = table_options or {}
    paths = paths or {}

    def declared(name: str, df: DataFrame) -> DataFrame:
        texts = {f.name.lower() for f in df.schema if isinstance(f.dataType, StringType)}

        def typed(f) -> Column:
            if isinstance(f.dataType, DateType):
                return (parse_date(f.name) if f.name in texts else F.col(f.name).try_cast(f.dataType)).alias(f.name)
            return F.col(f.name).cast(f.dataType).alias(f.name)

        return df.select(*[typed(f) for f in SCHEMAS[name]])

    def read(name: str) -> DataFrame:
        if fmt == "table":
            return declared(name, spark.table(f"{location}.{name}"))
        given = {**options, **table_options.get(name, {})}
        reader = spark.read.format(fmt).options(**given)
        if fmt == "jdbc":
            if name in PARTICIPATION and not PARTITIONED <= set(given):
                raise ValueError(f"give {', '.join(sorted(PARTITIONED))} to read {name} over JDBC")
            return declared(name, reader.option("url", location).option("dbtable", paths.get(name, name)).load())
        stored = reader.schema(SCHEMAS[name]).load(paths.get(name, f"{location.rstrip('/')}/{name}"))
        return stored.select(*SCHEMAS[name].names)  # without the columns that folders are named by

    return Tables(read)

"""Reports and table changes for a learning community, written as Spark jobs."""

from tertulia.schemas import SCHEMAS
from tertulia.sources.tables import Change, Tables, load_tables

__all__ = ["SCHEMAS", "Change", "Tables", "load_tables"]

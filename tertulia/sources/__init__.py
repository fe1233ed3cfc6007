from tertulia.sources.batches import store_batches, write_change
from tertulia.sources.layouts import write_buckets, write_by_month
from tertulia.sources.parts import read_parts, rewrite_parts, write_parts
from tertulia.sources.sinks import append_rows, merge_changed, write_snapshot
from tertulia.sources.tables import Change, Tables, load_tables

__all__ = [
    "Change",
    "Tables",
    "append_rows",
    "load_tables",
    "merge_changed",
    "read_parts",
    "rewrite_parts",
    "store_batches",
    "write_buckets",
    "write_by_month",
    "write_change",
    "write_parts",
    "write_snapshot",
]

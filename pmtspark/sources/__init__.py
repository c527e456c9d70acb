from pmtspark.sources.modules import MODULES
from pmtspark.sources.tables import (
    drop_range,
    literal_table,
    materialise,
    pick,
    read_module,
    read_table,
    scratch_root,
    strip_labels,
    write_scratch,
    write_table,
)

__all__ = [
    "MODULES",
    "drop_range",
    "literal_table",
    "materialise",
    "pick",
    "read_module",
    "read_table",
    "scratch_root",
    "strip_labels",
    "write_scratch",
    "write_table",
]

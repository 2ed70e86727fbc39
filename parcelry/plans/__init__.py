from parcelry.plans.run import RunReport, consolidate
from parcelry.plans.tables import (
    append_rows,
    count_rows,
    create_database,
    create_targets,
    drop_targets,
    missing_targets,
    overwrite_partitions,
    replace_partitions,
    replace_rows,
    table_exists,
    table_report,
)

__all__ = [
    "RunReport",
    "append_rows",
    "consolidate",
    "count_rows",
    "create_database",
    "create_targets",
    "drop_targets",
    "missing_targets",
    "overwrite_partitions",
    "replace_partitions",
    "replace_rows",
    "table_exists",
    "table_report",
]

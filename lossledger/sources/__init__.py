from lossledger.sources.sinks import append_table, export_csv, register_views, write_table
from lossledger.sources.staging import Staging
from lossledger.sources.wide import (
    clean_columns,
    device_signals,
    read_extract,
    read_wide,
    recover_timestamp,
)

__all__ = [
    "Staging",
    "append_table",
    "clean_columns",
    "device_signals",
    "export_csv",
    "read_extract",
    "read_wide",
    "recover_timestamp",
    "register_views",
    "write_table",
]

"""Sources and sinks: stored tables, roster files, snapshots, seeds, stand-ins."""

from .requests import read_requests, stream_requests
from .roster import normalize_roster, read_roster_file, roster_required_fields
from .tables import (committed_versions, read_driver_table, read_snapshot, snapshot_path,
                     table_scan, write_snapshot)

__all__ = [
    "committed_versions", "normalize_roster", "read_driver_table", "read_requests", "read_roster_file",
    "read_snapshot", "roster_required_fields", "snapshot_path", "stream_requests", "table_scan", "write_snapshot",
]

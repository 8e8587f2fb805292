"""Where rows come from: the snapshot log, flat catalogs, file systems, inventory tables."""

from .filesystem import ScanResult, discover_experiments, scan_roots
from .flat import FlatLog
from .inventory import from_table
from .log import LogStore, Snapshot
from .sums import DirectorySums

__all__ = [
    "DirectorySums", "FlatLog", "LogStore", "ScanResult", "Snapshot", "discover_experiments",
    "from_table", "scan_roots",
]

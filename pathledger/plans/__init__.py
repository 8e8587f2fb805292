"""Whole jobs over a catalog: snapshot, consolidation, batch index."""

from .batch import dry_run, index_experiments
from .consolidate import archive_snapshots, consolidate, purge
from .snapshot import Change, record_snapshot, snapshot_tree

__all__ = [
    "Change", "archive_snapshots", "consolidate", "dry_run", "index_experiments",
    "purge", "record_snapshot", "snapshot_tree",
]

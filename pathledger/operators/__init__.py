"""Relational operators over inventories and logs; each is DataFrame -> DataFrame."""

from .archive import archive_locations, purge_dates, restore_manifest
from .browse import list_directories, list_directory
from .diff import (
    added_entries,
    change_counts,
    modified_entries,
    removed_entries,
    restored_entries,
    snapshot_diff,
)
from .rollup import directory_totals, rolled_directories, rolled_nodes, rolled_stats, signed_totals
from .search import find, with_status
from .stats import catalog_stats, count_files, dry_run_counts, total_size
from .tree import tree_lines, tree_nodes
from .versions import (
    deltas_after_base,
    latest_base,
    live_snapshots,
    merge_on_read,
    replay,
    snapshot_summary,
)
from .views import files_view, files_view_base_only, files_view_selective

__all__ = [
    "added_entries", "archive_locations", "catalog_stats", "change_counts", "count_files",
    "deltas_after_base", "directory_totals", "dry_run_counts", "files_view", "files_view_base_only",
    "files_view_selective", "find", "latest_base", "list_directories", "list_directory",
    "live_snapshots", "merge_on_read", "modified_entries", "purge_dates", "removed_entries",
    "replay", "restore_manifest", "restored_entries", "rolled_directories", "rolled_nodes",
    "rolled_stats", "signed_totals", "snapshot_diff", "snapshot_summary",
    "total_size", "tree_lines", "tree_nodes", "with_status",
]

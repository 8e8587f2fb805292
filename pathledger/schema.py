"""Column layout of the inventory log, declared once.

Every reader passes these schemas explicitly: a column an older file lacks
comes back as NULL, and partition values such as ``12e45678`` stay text.
"""

from pyspark.sql import types as T

# One row per file and snapshot.
FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("owner", T.StringType()),
        T.StructField("group_name", T.StringType()),
        T.StructField("permissions", T.IntegerType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("indexed_at", T.StringType()),
        T.StructField("on_disk", T.BooleanType()),
        T.StructField("status", T.StringType()),
    ]
)

# Where a row lives: these three are directory names of the log.
PARTITION_COLUMNS = ["snapshot_ts", "kind", "exp_dir"]

LOG_SCHEMA = T.StructType(
    FILE_SCHEMA.fields + [T.StructField(c, T.StringType()) for c in PARTITION_COLUMNS]
)

# The ``files`` relation that browsing, searching and SQL see.
VIEW_COLUMNS = [f.name for f in FILE_SCHEMA if f.name != "status"]

# Result columns of ls and find; archive_uri is NULL until a manifest is attached.
ENTRY_COLUMNS = [
    "path", "parent_path", "filename", "size", "mtime", "owner", "group_name",
    "permissions", "checksum", "archive_uri", "experiment", "run", "indexed_at", "on_disk",
]

KEY = ["exp_dir", "path"]

BASE, DELTA = "base", "delta"
ADDED, MODIFIED, REMOVED = "added", "modified", "removed"

# File-type bits of st_mode (fixed by POSIX).
S_IFMT, S_IFLNK, S_IFREG = 0o170000, 0o120000, 0o100000

# One row per snapshot and action: "add" makes a snapshot visible, "retire" hides it;
# "archive" and "purge" record what then became of its files.
COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("exp_dir", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("snapshot_ts", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("n_added", T.LongType()),
        T.StructField("n_modified", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("key_bytes", T.LongType()),
        # The one experiment that all entries name; NULL if there are several, or in older commits.
        T.StructField("experiment", T.StringType()),
        # The folder of the write, the number of files, and whether some lie in folders of earlier writes.
        T.StructField("write", T.StringType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("shared", T.BooleanType()),
        T.StructField("committed_at", T.StringType()),
    ]
)

# What tells snapshots apart: two writers may choose the same time.
SNAPSHOT_KEY = ["exp_dir", "kind", "snapshot_ts", "write"]

# One row per file of a base: where it lies and which entries it can hold. ``least`` and
# ``greatest`` are sort keys, see ``sources.log.sort_key``.
ZONE_SCHEMA = T.StructType(
    [
        T.StructField("exp_dir", T.StringType()),
        T.StructField("at_write", T.StringType()),
        T.StructField("at_ts", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("least", T.StringType()),
        T.StructField("greatest", T.StringType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("experiment", T.StringType()),
    ]
)

# Totals of a directory: entries directly in it, removed ones included, and those on disk.
TOTALS = ["total_count", "total_size", "on_disk_count", "on_disk_size"]

# One row per snapshot and directory, see ``sources.sums``.
SUM_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (*SNAPSHOT_KEY, "directory")]
    + [T.StructField(c, T.LongType()) for c in TOTALS]
)

"""The same results in SQL that DuckDB runs on the given tables."""

from .queries import (
    DEEP_DIRS_PATH,
    DIRS_PATH,
    EXPERIMENT,
    FUZZY,
    LARGE,
    LS_PATH,
    SINCE,
    SMALL,
    SQL,
    TREE_PATH,
    UNTIL,
)

# The derived relations, as plain SQL.
INVENTORY = """
inventory AS (
 SELECT k, t, hutch, experiment,
        '/ds/' || hutch || '/' || experiment || sub || '/f_' || CAST(k AS STRING) || ext AS path,
        '/ds/' || hutch || '/' || experiment || sub AS parent_path,
        'f_' || CAST(k AS STRING) || ext AS filename,
        1 + (k * 7919123) % 3000000000
          + CASE WHEN hutch IN ('cxi','mfx') AND t >= 1 AND k % 11 = 0 THEN 1 ELSE 0 END
          + CASE WHEN hutch IN ('cxi','mfx') AND t >= 2 AND k % 19 = 0 THEN 2 ELSE 0 END AS size,
        1700000000 + (k * 37) % 10000000 AS mtime,
        CASE WHEN k % 17 = 0 THEN 41471 ELSE 33188 END AS permissions,
        CASE WHEN k % 3 = 2 THEN NULL ELSE CAST(k % 25 AS INT) END AS run
 FROM (SELECT o_orderkey AS k, t,
              CASE o_orderkey % 4 WHEN 0 THEN 'cxi' WHEN 1 THEN 'mfx' WHEN 2 THEN 'xpp' ELSE 'mec' END AS hutch,
              CASE o_orderkey % 4 WHEN 0 THEN 'cxi' WHEN 1 THEN 'mfx' WHEN 2 THEN 'xpp' ELSE 'mec' END
                || lpad(CAST(o_custkey % 12 AS STRING), 5, '0') AS experiment,
              CASE o_orderkey % 3 WHEN 0 THEN '/scratch' WHEN 1 THEN '/xtc' ELSE '/results' END
                || CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE '/run' || lpad(CAST(o_orderkey % 25 AS STRING), 4, '0') END AS sub,
              CASE o_orderkey % 5 WHEN 0 THEN '.h5' WHEN 1 THEN '.xtc2' WHEN 2 THEN '.npz' WHEN 3 THEN '.txt' ELSE '.dat' END AS ext
       FROM orders CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1 UNION ALL SELECT 2) ts)
 WHERE ((t = 0 OR hutch NOT IN ('cxi','mfx')) AND k % 10 <> 9)
    OR (hutch IN ('cxi','mfx') AND ((t = 1 AND k % 7 <> 3) OR (t = 2 AND k % 13 <> 5))))"""

SNAPSHOT_LOG = """
snapshot_log AS (
 SELECT path, parent_path, filename, size, mtime, permissions, experiment, run,
        't0' AS indexed_at, true AS on_disk, CAST(NULL AS STRING) AS status FROM inventory WHERE t = 0
 UNION ALL
 SELECT COALESCE(c.path,p.path), COALESCE(c.parent_path,p.parent_path), COALESCE(c.filename,p.filename),
        COALESCE(c.size,p.size), COALESCE(c.mtime,p.mtime), COALESCE(c.permissions,p.permissions),
        COALESCE(c.experiment,p.experiment), CASE WHEN c.path IS NOT NULL THEN c.run ELSE p.run END,
        't1', CAST(NULL AS BOOLEAN),
        CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'modified' END
 FROM (SELECT * FROM inventory WHERE t = 0) p
 FULL OUTER JOIN (SELECT * FROM inventory WHERE t = 1) c ON c.path = p.path
 WHERE p.path IS NULL OR c.path IS NULL OR c.size <> p.size OR c.mtime <> p.mtime
 UNION ALL
 SELECT COALESCE(c.path,p.path), COALESCE(c.parent_path,p.parent_path), COALESCE(c.filename,p.filename),
        COALESCE(c.size,p.size), COALESCE(c.mtime,p.mtime), COALESCE(c.permissions,p.permissions),
        COALESCE(c.experiment,p.experiment), CASE WHEN c.path IS NOT NULL THEN c.run ELSE p.run END,
        't2', CAST(NULL AS BOOLEAN),
        CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'modified' END
 FROM (SELECT * FROM inventory WHERE t = 1) p
 FULL OUTER JOIN (SELECT * FROM inventory WHERE t = 2) c ON c.path = p.path
 WHERE p.path IS NULL OR c.path IS NULL OR c.size <> p.size OR c.mtime <> p.mtime)"""

FILES = """
files AS (
 SELECT path, parent_path, filename, size, mtime, permissions, experiment, run, indexed_at,
        CASE WHEN on_disk IS NOT NULL THEN on_disk WHEN status IS NOT NULL THEN status <> 'removed' ELSE true END AS on_disk
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS _rn FROM snapshot_log) x
 WHERE _rn = 1)"""

CTES = f"WITH {INVENTORY},\n{SNAPSHOT_LOG},\n{FILES}\n"

VIEW = "path, parent_path, filename, size, mtime, permissions, experiment, run, indexed_at, on_disk"
FILE = "path, parent_path, filename, size, mtime, permissions, experiment, run"

# The state after the second scan, and the third scan.
SCANS = """,
state AS (
 SELECT path, parent_path, filename, size, mtime, permissions, experiment, run,
        status IS NULL OR status <> 'removed' AS on_disk
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn
       FROM snapshot_log
       WHERE indexed_at < 't2') v
 WHERE rn = 1),
scan AS (SELECT * FROM inventory WHERE t = 2),
changes AS (
 SELECT path, parent_path, filename, size, mtime, permissions, experiment, run, 'added' AS status
 FROM scan WHERE path NOT IN (SELECT path FROM state WHERE on_disk)
 UNION ALL
 SELECT s.path, s.parent_path, s.filename, s.size, s.mtime, s.permissions, s.experiment, s.run,
        'modified'
 FROM scan s JOIN state p ON s.path = p.path
 WHERE p.on_disk AND (s.size <> p.size OR s.mtime <> p.mtime)
 UNION ALL
 SELECT path, parent_path, filename, size, mtime, permissions, experiment, run, 'removed'
 FROM state WHERE on_disk AND path NOT IN (SELECT path FROM scan))
"""

SNAPSHOTS = """,
snapshots AS (
 SELECT experiment AS exp_dir, CASE WHEN indexed_at = 't0' THEN 'base' ELSE 'delta' END AS kind,
        indexed_at AS snapshot_ts, COUNT(*) AS record_count,
        COUNT(*) FILTER (WHERE status IS NULL OR status = 'added') AS n_added,
        COUNT(*) FILTER (WHERE status = 'modified') AS n_modified,
        COUNT(*) FILTER (WHERE status = 'removed') AS n_removed,
        CAST(SUM(strlen(path)) AS BIGINT) AS key_bytes
 FROM snapshot_log GROUP BY experiment, indexed_at)
"""

MANIFEST = """,
manifest AS (
 SELECT path, 'tape://' || CAST(k % 100 AS STRING) || '/' || CAST(k AS STRING) AS archive_uri
 FROM inventory WHERE t = 0 AND k % 3 = 0)
"""


def _size_human(size: str) -> str:
    steps = ["B", "KB", "MB", "GB", "TB"]
    cases = "".join(
        f" WHEN abs({size}) < {1024 ** (i + 1)} "
        f"THEN printf('%.1f {unit}', CAST({size} AS DOUBLE) / {1024**i})"
        for i, unit in enumerate(steps)
    )
    return (
        f"CASE WHEN {size} IS NULL THEN 'N/A'{cases} "
        f"ELSE printf('%.1f PB', CAST({size} AS DOUBLE) / {1024**5}) END"
    )


def _find(condition: str) -> str:
    return f"{CTES} SELECT {VIEW} FROM files WHERE {condition}"


def _ls_dirs(path: str, condition: str = "true") -> str:
    prefix = path.rstrip("/") + "/"
    return f"""{CTES}
        SELECT dirname, CAST(SUM(size) AS BIGINT) AS total_size, COUNT(*) AS file_count
        FROM (SELECT split_part(substr(parent_path, {len(prefix) + 1}), '/', 1) AS dirname, size
              FROM files WHERE starts_with(parent_path, '{prefix}') AND {condition}) d
        WHERE dirname <> '' GROUP BY dirname"""


def _nodes(depth: int) -> str:
    """Visible nodes below TREE_PATH, each level its own select."""
    levels = []
    for level in range(1, depth + 1):
        node = " || '/' || ".join(f"split_part(rest, '/', {i})" for i in range(1, level + 1))
        levels.append(
            f"SELECT {node} AS node, {level} AS level, n > {level} AS is_dir, "
            f"COUNT(*) AS file_count, CAST(SUM(size) AS BIGINT) AS total_size "
            f"FROM below WHERE n >= {level} GROUP BY ALL"
        )
    return f""",
below AS (
 SELECT rest, size, length(rest) - length(replace(rest, '/', '')) + 1 AS n
 FROM (SELECT substr(path, {len(TREE_PATH) + 2}) AS rest, size FROM files
       WHERE on_disk AND starts_with(path, '{TREE_PATH}/')) r),
nodes AS ({" UNION ALL ".join(levels)})
"""


TREE_LINES = f"""{CTES}{_nodes(2)},
named AS (
 SELECT *, split_part(node, '/', level) AS name,
        CASE WHEN level = 1 THEN '' ELSE split_part(node, '/', 1) END AS parent FROM nodes),
placed AS (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY parent ORDER BY name DESC, is_dir) = 1 AS is_last
 FROM named)
SELECT '{TREE_PATH}' AS line
UNION ALL
SELECT CASE WHEN p.level = 1 THEN '' WHEN up.is_last THEN '    ' ELSE '│   ' END
       || CASE WHEN p.is_last THEN '└── ' ELSE '├── ' END || p.name
       || CASE WHEN p.is_dir THEN '/ (' || CAST(p.file_count AS STRING) || ' files, ' ELSE ' (' END
       || {_size_human("p.total_size")} || ')'
FROM placed p LEFT JOIN placed up ON up.level = 1 AND up.is_dir AND up.name = p.parent
"""

ORACLES: dict[str, str] = {
    "read_log": f"{CTES} SELECT {VIEW}, status FROM snapshot_log",
    "write_base": f"""{CTES}{SNAPSHOTS}
        SELECT exp_dir, snapshot_ts, n_added, n_modified, n_removed
        FROM snapshots WHERE kind = 'base'""",
    "write_delta": f"""{CTES}{SNAPSHOTS}
        SELECT exp_dir, snapshot_ts, n_added, n_modified, n_removed, key_bytes
        FROM snapshots WHERE kind = 'delta'""",
    "list_snapshots": f"""{CTES}{SNAPSHOTS}
        SELECT exp_dir AS experiment, kind AS type, snapshot_ts AS timestamp, record_count
        FROM snapshots""",
    "snapshot_summary": f"""{CTES}{SNAPSHOTS}
        SELECT exp_dir, kind, snapshot_ts, record_count FROM snapshots""",
    "scan_tree": """
        SELECT lang || '/' || source AS directory, COUNT(*) AS file_count, CAST(SUM(strlen(text)) AS BIGINT) AS total_size
        FROM documents GROUP BY 1""",
    "checksum_sha256": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "archive_snapshots": f"""{CTES}{SNAPSHOTS}
        SELECT exp_dir, kind, snapshot_ts, record_count FROM snapshots
        WHERE exp_dir IN (SELECT exp_dir FROM snapshots WHERE kind = 'delta')""",
    "path_parts": r"""
        SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent_path,
               regexp_extract(url, '[^/]*$') AS filename
        FROM pages""",
    "run_extract": r"""
        SELECT o_orderkey, TRY_CAST(NULLIF(regexp_extract(path, 'run(\d+)', 1), '') AS INT) AS run
        FROM (SELECT o_orderkey, CASE o_orderkey % 5
                WHEN 0 THEN '/brun' || o_orderkey || '/run0003/f'
                WHEN 1 THEN '/scratch/run' || lpad(CAST(o_orderkey AS STRING), 9, '0') || '/f'
                WHEN 2 THEN '/results/f_' || o_orderkey
                WHEN 3 THEN '/xtc/run' || (o_orderkey * 1000003)
                ELSE '/runs/RUN/run' || o_orderkey || '/run1' END AS path
              FROM orders) p""",
    "exp_dir_name": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'exp' || o_orderkey
               ELSE substr(md5('/ds/' || o_orderkey), 1, 8) END AS exp_dir
        FROM orders""",
    "parse_size": """
        SELECT o_orderkey, CASE o_orderkey % 8
               WHEN 0 THEN o_orderkey
               WHEN 1 THEN o_orderkey * 1024
               WHEN 2 THEN CAST(trunc(CAST(o_orderkey || '.' || (o_orderkey % 100) AS DOUBLE)
                                      * 1048576) AS BIGINT)
               WHEN 3 THEN o_orderkey * 1073741824
               WHEN 4 THEN (o_orderkey % 1000) * 1099511627776 + 549755813888
               WHEN 5 THEN (o_orderkey % 1000) * 1125899906842624
               WHEN 7 THEN o_orderkey END AS size
        FROM orders""",
    "size_human": f"""
        SELECT o_orderkey, size, {_size_human("size")} AS size_human
        FROM (SELECT o_orderkey, CASE o_orderkey % 6
                WHEN 0 THEN o_orderkey % 2048
                WHEN 1 THEN o_orderkey * 64
                WHEN 2 THEN (o_orderkey * 7919123) % 3000000000
                WHEN 3 THEN o_orderkey * 1048576 + 524288
                WHEN 4 THEN o_orderkey * 68719476736 END AS size
              FROM orders) s""",
    "snapshot_diff": f"{CTES}{SCANS} SELECT {FILE}, status FROM changes",
    "diff_added": f"""{CTES}{SCANS}
        SELECT {FILE} FROM scan WHERE path NOT IN (SELECT path FROM state)""",
    "diff_removed": f"{CTES}{SCANS} SELECT {FILE} FROM changes WHERE status = 'removed'",
    "diff_modified": f"{CTES}{SCANS} SELECT {FILE} FROM changes WHERE status = 'modified'",
    "diff_restored": f"""{CTES}{SCANS}
        SELECT {FILE} FROM scan WHERE path IN (SELECT path FROM state WHERE NOT on_disk)""",
    "diff_counts": f"""{CTES}{SCANS}
        SELECT experiment, COUNT(*) FILTER (WHERE status = 'added') AS added,
               COUNT(*) FILTER (WHERE status = 'modified') AS modified,
               COUNT(*) FILTER (WHERE status = 'removed') AS removed
        FROM changes GROUP BY experiment""",
    "latest_base": f"""{CTES}
        SELECT experiment AS exp_dir, MAX(indexed_at) AS base_ts
        FROM snapshot_log WHERE status IS NULL GROUP BY experiment""",
    "deltas_after_base": f"""{CTES}{SNAPSHOTS}
        SELECT exp_dir, kind, snapshot_ts, record_count FROM snapshots s
        WHERE kind = 'delta' AND snapshot_ts > (
            SELECT MAX(snapshot_ts) FROM snapshots b
            WHERE b.kind = 'base' AND b.exp_dir = s.exp_dir)""",
    "files_view_base_only": f"""{CTES}
        SELECT {FILE}, 't0' AS indexed_at, true AS on_disk FROM inventory WHERE t = 0""",
    **{
        name: f"{CTES} SELECT {VIEW} FROM files"
        for name in (
            "current_state", "files_view", "files_view_selective", "files_view_by_path",
            "files_view_merged", "files_view_stored", "consolidate",
        )
    },
    "index_report": f"""{CTES}
        SELECT substr(experiment, 1, 3) AS hutch, experiment,
               COUNT(*) FILTER (WHERE indexed_at = 't2' AND status = 'added') AS added,
               COUNT(*) FILTER (WHERE indexed_at = 't2' AND status = 'modified') AS modified,
               COUNT(*) FILTER (WHERE indexed_at = 't2' AND status = 'removed') AS removed
        FROM snapshot_log GROUP BY experiment""",
    "dry_run_counts": f"""{CTES}
        SELECT hutch, experiment, COUNT(*) AS file_count FROM inventory
        WHERE t = 0 AND (permissions & 61440) = 32768 GROUP BY hutch, experiment""",
    "ls": _find(f"parent_path = '{LS_PATH}'"),
    "ls_on_disk": _find(f"parent_path = '{LS_PATH}' AND on_disk"),
    "ls_dirs": _ls_dirs(DIRS_PATH),
    "ls_dirs_on_disk": _ls_dirs(DEEP_DIRS_PATH, "on_disk"),
    "find_like": _find("path LIKE '%/run000_/%.h5'"),
    "find_exclude": _find("path NOT LIKE '%.h5' AND path NOT LIKE '%/scratch/%'"),
    "find_size_range": _find(f"size > {SMALL} AND size < {LARGE}"),
    "find_experiment": _find(f"experiment = '{EXPERIMENT}'"),
    "find_removed": _find("on_disk = false"),
    "find_on_disk": _find("on_disk = true"),
    "find_no_symlinks": _find("(permissions & 61440) <> 40960"),
    "find_status": f"""{CTES}
        SELECT path, {_size_human("size")} AS size_human,
               CASE WHEN on_disk THEN '' ELSE '[removed]' END AS state
        FROM files WHERE path LIKE '%.txt'""",
    "find_combined": _find(
        f"path LIKE '/ds/%' AND size > {SMALL} AND path NOT LIKE '%.xtc2' AND on_disk "
        "AND (permissions & 61440) <> 40960"
    ),
    "tree_nodes": f"""{CTES}{_nodes(3)}
        SELECT node, is_dir, file_count, total_size FROM nodes""",
    "tree_lines": TREE_LINES,
    "count_all": f"{CTES} SELECT COUNT(*) AS file_count FROM files",
    "count_on_disk": f"{CTES} SELECT COUNT(*) AS file_count FROM files WHERE on_disk",
    "total_size": f"{CTES} SELECT CAST(COALESCE(SUM(size), 0) AS BIGINT) AS total_size FROM files",
    "total_size_on_disk": f"""{CTES}
        SELECT CAST(COALESCE(SUM(size), 0) AS BIGINT) AS total_size FROM files WHERE on_disk""",
    "stats": f"""{CTES}
        SELECT COUNT(*) AS total_count, COUNT(*) FILTER (WHERE on_disk) AS on_disk_count,
               CAST(COALESCE(SUM(size), 0) AS BIGINT) AS total_size,
               CAST(COALESCE(SUM(size) FILTER (WHERE on_disk), 0) AS BIGINT) AS on_disk_size
        FROM files""",
    **{name: CTES + text for name, text in SQL.items()},
    "archive_locations": f"""{CTES}{MANIFEST}
        SELECT {", ".join("f." + c.strip() for c in VIEW.split(","))}, m.archive_uri
        FROM files f LEFT JOIN manifest m ON f.path = m.path""",
    "restore_manifest": f"""{CTES}{MANIFEST}
        SELECT f.path, m.archive_uri, f.size
        FROM files f JOIN manifest m ON f.path = m.path WHERE NOT f.on_disk""",
    "find_extension": _find("filename LIKE '%.npz'"),
    "find_regex": _find(r"regexp_matches(path, '/run00(1[0-9]|2[0-4])/f_[0-9]*7\.')"),
    "find_fuzzy": _find(f"levenshtein(filename, '{FUZZY}') <= 2"),
    "find_mtime_range": _find(f"mtime >= {SINCE} AND mtime < {UNTIL}"),
    "purge_dates": f"{CTES} SELECT path, size, indexed_at AS purge_date FROM files WHERE NOT on_disk",
}

# Which queries ask a stored catalog what another asks the derived relation.
STORED = {
    "catalog_ls": "ls",
    "catalog_ls_dirs": "ls_dirs",
    "catalog_find": "find_combined",
    "catalog_find_experiment": "find_experiment",
    "catalog_tree": "tree_lines",
    "catalog_stats": "stats",
    "catalog_sql": "sql_by_experiment",
    "summed_ls_dirs": "ls_dirs_on_disk",
    "summed_tree": "tree_lines",
    "summed_stats": "stats",
}
ORACLES |= {name: ORACLES[same] for name, same in STORED.items()}
ORACLES |= {
    "directory_totals": f"""{CTES}
        SELECT experiment AS exp_dir, parent_path AS directory, COUNT(*) AS total_count,
               CAST(SUM(size) AS BIGINT) AS total_size, COUNT(*) FILTER (WHERE on_disk) AS on_disk_count,
               CAST(COALESCE(SUM(size) FILTER (WHERE on_disk), 0) AS BIGINT) AS on_disk_size
        FROM files GROUP BY experiment, parent_path""",
    "checksum_files": "SELECT doc_id, sha256(text) AS checksum, strlen(text) AS size FROM documents",
    "index_tree": """
        SELECT lang AS hutch, source AS experiment, COUNT(*) AS added,
               CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS removed
        FROM documents GROUP BY lang, source""",
    "base_or_delta": f"{CTES}{SNAPSHOTS} SELECT exp_dir, snapshot_ts, kind FROM snapshots",
    "tsv_sink": f"{CTES} SELECT path, size, run FROM files WHERE on_disk = false",
}

"""Compaction: one base per experiment in place of a base and its deltas."""

from bisect import bisect_right
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASE, COMMIT_SCHEMA, FILE_SCHEMA, PARTITION_COLUMNS, SNAPSHOT_KEY, ZONE_SCHEMA
from ..sources.local import local_frame, strings
from ..sources.log import (
    TIMESTAMP, LiveLog, LogStore, Snapshot, as_snapshot, commit_rows, new_write, sort_key, split_live, timestamp_now,
)
from ..sources.storage import partition_dir
from ..sources.sums import DirectorySums

# Snapshots that one copying job reads.
ARCHIVED_AT_ONCE = 1000
# Zones of this many bytes at most are sent to the tasks that look up the keys of deltas.
ZONE_BYTES = 64 * 1024 * 1024


def consolidate(
    store: LogStore,
    archive_dir: str | None = None,
    snapshot_ts: str | None = None,
    exp_dirs: Iterable[str] | None = None,
) -> dict[str, int]:
    """Rewrites every experiment that has several snapshots as a single new base.

    Removed entries stay, each with the time of its removal. Files of a base that no delta
    meets become part of the new one as they are; only the others are read and rewritten,
    together with what deltas add between them. All experiments are one Spark job; the
    commit swaps old snapshots for new at once. Files of the old ones are copied to
    ``archive_dir``, if given, and stay until :func:`purge`, so a query planned before
    still runs after.
    """
    snapshot_ts = snapshot_ts or timestamp_now()
    snapshots = store.snapshots()
    if exp_dirs is not None:
        wanted = local_frame(store.spark, [(e,) for e in exp_dirs], strings("exp_dir"))
        snapshots = snapshots.join(wanted, "exp_dir", "left_semi")
    several = (
        snapshots.groupBy("exp_dir")
        .agg(F.count("*").alias("n"), F.count_if(F.col("kind") == BASE).alias("bases"))
        .filter("n > 1 AND bases > 0")
    )
    # Read before writing: what is retired is exactly what was merged.
    old = store.listed(snapshots.join(several, "exp_dir", "left_semi"))
    chosen = sorted({r.exp_dir for r in old})
    stats = {"experiments": len(chosen), "files_removed": 0, "files_archived": 0}
    if chosen:
        newest = store.newest(chosen)
        if newest >= snapshot_ts:
            raise ValueError(f"snapshot {snapshot_ts} is not after {newest}")
        write = new_write()
        rows = _rewrite(store, old, write, snapshot_ts)
        # Snapshots of different roots leave a base whose root is unknown.
        roots: dict[str, set] = {}
        for r in old:
            roots.setdefault(r.exp_dir, set()).add(r.root)
        root = {e: found.pop() if len(found) == 1 else None for e, found in roots.items()}
        added = [row for m in rows for row in commit_rows("add", [m], root=root[m.exp_dir])]
        retired = commit_rows("retire", [as_snapshot(r) for r in old], n_files=None, shared=None)
        store.commit(local_frame(store.spark, added + retired, COMMIT_SCHEMA))
        stats["files_removed"] = len(old)
    if archive_dir:
        stats["files_archived"], stats["files_removed"] = archive_snapshots(store, archive_dir), 0
    return stats


def _rewrite(store: LogStore, old: list, write: str, snapshot_ts: str) -> list:
    """Writes the new bases; returns their commit columns."""
    parts = split_live(old)
    bases = parts.settled + parts.bases
    split = [r for r in bases if (r.n_files or 0) > 1]
    carried, touched = [], []
    # Two sort keys and a name a file; beyond the bound, every file counts as touched.
    if split and parts.deltas and sum(r.n_files for r in split) * 1024 <= ZONE_BYTES:
        zones = store.zones(as_snapshot(r) for r in split).select(*ZONE_SCHEMA.names).collect()
        met = _met(store.read(as_snapshot(r) for r in parts.deltas), zones)
        carried = [z for i, z in enumerate(zones) if i not in met]
        touched = [z for i, z in enumerate(zones) if i in met]
        bases = [r for r in bases if r not in split]
    files = [store.snapshot_dir(as_snapshot(r)) for r in bases if not r.shared] + [store.zone_file(z) for z in touched]
    shared = [as_snapshot(r) for r in bases if r.shared]
    files += [store.zone_file(z) for z in store.zones(shared).collect()] if shared else []
    n_rows = sum(r.n_records for r in [*bases, *touched, *parts.deltas])
    nothing = store.read([])
    live = LiveLog(
        nothing, store._scan(files), store.read(as_snapshot(r) for r in parts.deltas),
        store.keys_fit(parts.deltas), set(), n_rows,
    )
    state = live.state().withColumn("status", F.lit(None).cast("string"))
    store.write_base(state, write, snapshot_ts, n_rows, at_least=len(touched))
    measured = store.measure_base(write, snapshot_ts)
    if carried:
        store.add_zones(local_frame(store.spark, carried, ZONE_SCHEMA), write)
        names = local_frame(store.spark, sorted({(write, r.exp_dir) for r in old}), strings("write", "exp_dir"))
        zones = store.zones(Snapshot(e, BASE, snapshot_ts, write) for e in {r.exp_dir for r in old})
        measured = store.sum_zones(zones.join(names, ["write", "exp_dir"], "left_semi"), write, snapshot_ts)
    return measured


def _met(deltas: DataFrame, zones: list) -> set[int]:
    """Numbers of the zones that hold a key of the deltas; the keys stay on the executors."""
    by_exp: dict[str, tuple[list, list, list, list]] = {}
    order = sorted(range(len(zones)), key=lambda i: (zones[i].exp_dir, zones[i].least.encode()))
    for i in order:
        zone = zones[i]
        least, greatest, reach, numbers = by_exp.setdefault(zone.exp_dir, ([], [], [], []))
        least.append(zone.least.encode())
        greatest.append(zone.greatest.encode())
        reach.append(max(greatest[-1], reach[-1]) if reach else greatest[-1])
        numbers.append(i)
    sent = deltas.sparkSession.sparkContext.broadcast(by_exp)

    def run(batches):
        found: set[int] = set()
        for batch in batches:
            for exp_dir, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if exp_dir not in sent.value:
                    continue
                least, greatest, reach, numbers = sent.value[exp_dir]
                key = key.encode()
                at = bisect_right(least, key) - 1
                # Zones may overlap: go back while any earlier one reaches as far as the key.
                while at >= 0 and reach[at] >= key:
                    if greatest[at] >= key:
                        found.add(numbers[at])
                    at -= 1
        yield pa.RecordBatch.from_pydict({"zone": pa.array(sorted(found), pa.int64())})

    keys = deltas.select("exp_dir", sort_key(F.col("parent_path"), F.col("filename")).alias("key"))
    return {r.zone for r in keys.mapInArrow(run, "zone long").distinct().collect()}


def _present(store: LogStore) -> DataFrame:
    """Snapshots not purged, when they retired (null if they are live), and whether they are archived."""
    return (
        store.commits()
        .groupBy(*SNAPSHOT_KEY)
        .agg(
            F.max("shared").alias("shared"),
            F.max("n_files").alias("n_files"),
            F.max(F.when(F.col("action") == "retire", F.col("committed_at"))).alias("retired_at"),
            F.bool_or(F.col("action") == "archive").alias("archived"),
            F.bool_or(F.col("action") == "purge").alias("purged"),
        )
        .filter("NOT purged")
    )


def archive_snapshots(store: LogStore, archive_dir: str) -> int:
    """Copies retired snapshots to ``<archive>/exp_dir=/kind=/snapshot_ts=``, in batches.

    Copies are committed before any original goes. Returns the number of snapshots copied.
    """
    pending = _present(store).filter("retired_at IS NOT NULL AND NOT archived")
    missing = [_snapshot(r) for r in pending.collect()]
    for i in range(0, len(missing), ARCHIVED_AT_ONCE):
        batch = missing[i : i + ARCHIVED_AT_ONCE]
        _copy(store, batch, archive_dir)
        _mark(store, batch, "archive")
    return len(missing)


def purge(store: LogStore, older_than: timedelta) -> int:
    """Deletes files of snapshots retired at least so long ago, and of writes begun as long
    ago that no commit names. Returns the number of snapshots deleted."""
    limit = (datetime.now(UTC) - older_than).strftime(TIMESTAMP)
    present = _present(store).collect()
    doomed = [r for r in present if r.retired_at is not None and r.retired_at <= limit]
    kept = [r for r in present if r not in doomed]
    # Files that a base not yet to go shares with earlier writes, and those the doomed share.
    held = _shared_files(store, kept)
    whole = {store.folder(r.write) for r in doomed} - {store.folder(r.write) for r in kept}
    whole -= {folder for folder in whole if any(f.startswith(folder + "/") for f in held)}
    single = {store.snapshot_dir(_snapshot(r)) for r in doomed if store.folder(r.write) not in whole}
    _each(store.storage.delete, whole)
    for folder in single:
        inside = [f"{folder}/{name}" for name, _ in store.storage.children(folder)]
        rest = [f for f in inside if f not in held]
        _each(store.storage.delete, [folder] if len(rest) == len(inside) else rest)
    _each(store.storage.delete, _shared_files(store, doomed) - held)
    if doomed:
        _mark(store, [_snapshot(r) for r in doomed], "purge")
    gone = {r.write for r in doomed} - {r.write for r in kept}
    _each(store.storage.delete, [f"{store.zones_dir}/{partition_dir('write', w)}" for w in gone])
    DirectorySums(store).drop(kept, limit)
    # Writes that began so long ago and that no commit ever named.
    known = store.commits().filter("action = 'add'").select("write").distinct()
    named = {partition_dir("write", r.write) for r in known.collect() if r.write is not None}
    began = partition_dir("write", limit)
    for parent in (store.log_dir, store.zones_dir):
        orphans = [
            name for name, _ in store.storage.children(parent)
            if name.startswith("write=") and name not in named and name <= began
        ]
        _each(lambda name, parent=parent: store.storage.delete(f"{parent}/{name}"), orphans)
    return len(doomed)


def _snapshot(row) -> Snapshot:
    return Snapshot(*[row[c] for c in SNAPSHOT_KEY], bool(row.shared), row.n_files)


def _shared_files(store: LogStore, rows: Iterable) -> set[str]:
    """Files of bases that lie in folders of earlier writes."""
    shared = [_snapshot(r) for r in rows if r.shared]
    if not shared:
        return set()
    return {store.zone_file(z) for z in store.zones(shared).filter("at_write <> write").collect()}


def _mark(store: LogStore, snapshots: list[Snapshot], action: str) -> None:
    rows = commit_rows(action, snapshots, n_files=None, shared=None)
    store.commit(local_frame(store.spark, rows, COMMIT_SCHEMA))


def _each(operation: Callable, items: Iterable) -> None:
    """Metadata operations of the store, several at a time."""
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(operation, items))


def _copy(store: LogStore, snapshots: list[Snapshot], archive_dir: str) -> None:
    _copy_rows(store.read(s for s in snapshots if not s.shared), archive_dir)
    # Rows of shared files name the snapshot that wrote them; an experiment's bases go one by one.
    shared = sorted(s for s in snapshots if s.shared)
    while shared:
        now = {s.exp_dir: s for s in shared}
        shared = [s for s in shared if s not in now.values()]
        times = local_frame(store.spark, [(s.exp_dir, s.snapshot_ts) for s in now.values()], strings("exp_dir", "snapshot_ts"))
        _copy_rows(store.read(now.values()).drop("snapshot_ts").join(times, "exp_dir"), archive_dir)


def _copy_rows(rows: DataFrame, archive_dir: str) -> None:
    (
        rows.select(*FILE_SCHEMA.names, *PARTITION_COLUMNS)
        .hint("rebalance", "exp_dir", "snapshot_ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("exp_dir", "kind", "snapshot_ts")
        .parquet(archive_dir)
    )

"""Indexing many experiments in one job."""

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import dry_run_counts
from ..sources.filesystem import ScanResult, discover_experiments, scan_roots
from ..sources.local import local_frame, strings
from ..sources.log import LogStore, new_write, timestamp_now
from .snapshot import Change, counts_by_root, record_snapshot

REPORT = T.StructType(
    [
        T.StructField("hutch", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("added", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("removed", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

_COUNTS = T.StructType(REPORT.fields[:2] + [T.StructField("file_count", T.LongType())])


def index_experiments(
    store: LogStore,
    data_root: str,
    hutches: list[str],
    compute_checksum: bool = False,
    workers: int | None = None,
    batch_size: int = 10_000,
    **options,
) -> DataFrame:
    """Scans and records every experiment of the hutches: one walk, one diff, one commit.

    A hutch or experiment that cannot be read is reported and left as it was; the
    others go on. Unreadable parts inside a readable experiment are its errors; what
    lies below them stays as it was. If recording fails, the experiments are recorded by
    halves, so the failing ones alone are reported, each with its error.
    """
    targets = discover_experiments(store.spark, data_root, hutches).collect()
    good = [t for t in targets if not t.error]
    changes, problems, shared, by_root = {}, {}, [], {}
    if good:
        with store.staging() as staging:
            scan = scan_roots(
                store.spark,
                [(t.exp_dir, t.experiment, t.root) for t in good],
                staging,
                compute_checksum,
                workers,
                batch_size,
            )
            errors = scan.errors.groupBy("exp_dir").count().collect()
            problems = {r.exp_dir: f"{r['count']} entries unreadable" for r in errors}
            targets_of = [(t.exp_dir, t.root) for t in good]
            snapshot_ts = options.pop("snapshot_ts", None) or timestamp_now()
            recorded = _record_by_halves(store, scan, targets_of, snapshot_ts, options)
            changes = {c.exp_dir: c for c, _ in recorded}
            # One name in two hutches is one experiment with two roots.
            times = Counter(e for e, _ in targets_of)
            shared = [t for t in targets_of if times[t[0]] > 1 and not changes[t[0]].error]
            for write in {w for c, w in recorded if c.exp_dir in {e for e, _ in shared}}:
                inside = {c.exp_dir for c, w in recorded if w == write}
                by_root |= counts_by_root(store, write, snapshot_ts, [t for t in shared if t[0] in inside])
    rows = []
    for t in targets:
        change = None if t.error else changes.get(t.exp_dir)
        counts = (change.added, change.modified, change.removed) if change else (None,) * 3
        if change and (t.exp_dir, t.root) in shared:
            counts = by_root.get((t.exp_dir, t.root), (0, 0, 0))
        error = t.error or (change.error if change else None) or problems.get(t.exp_dir)
        rows.append((t.hutch, t.experiment, *counts, error))
    return local_frame(store.spark, rows, REPORT)


def _record_by_halves(
    store: LogStore, scan: ScanResult, targets: list[tuple[str, str]], snapshot_ts: str, options: dict
) -> list[tuple[Change, str]]:
    """Changes with the write that holds them; what fails is tried again as two halves.

    One failing experiment among n costs about 2 log2(n) further writes. Nothing of a failed
    write is visible, as its commit comes last; its files go at once. Should the commit itself
    have failed after it took effect, the halves are refused as not newer, and say so.
    """
    write = new_write()
    names = sorted({e for e, _ in targets})
    part = local_frame(store.spark, [(e,) for e in names], strings("exp_dir"))
    files = scan.files.join(part, "exp_dir", "left_semi")
    errors = scan.errors.join(part, "exp_dir", "left_semi")
    try:
        done = record_snapshot(
            store, files, targets, snapshot_ts, errors=errors, write=write, staged=True, **options
        )
        return [(change, write) for change in done]
    except Exception as error:  # noqa: BLE001 - whatever stops one experiment must not stop the others
        committed = store.commits().filter(F.col("write") == write)
        if committed.isEmpty():
            store.discard(write)
        if len(names) == 1:
            return [(Change(names[0], 0, 0, 0, f"{type(error).__name__}: {error}"), write)]
    half = set(names[: len(names) // 2])
    return [
        found
        for side in (True, False)
        for found in _record_by_halves(
            store, scan, [t for t in targets if (t[0] in half) == side], snapshot_ts, options
        )
    ]


def dry_run(store: LogStore, data_root: str, hutches: list[str], **scan_options) -> DataFrame:
    """Regular files per experiment, as the batch index would find them; writes no snapshot."""
    spark = store.spark
    targets = [t for t in discover_experiments(spark, data_root, hutches).collect() if not t.error]
    if not targets:
        return local_frame(spark, [], _COUNTS)
    names = local_frame(
        spark,
        [(t.exp_dir, t.hutch, t.experiment) for t in targets],
        strings("exp_dir", "hutch", "experiment"),
    )
    with store.staging() as staging:
        scan = scan_roots(
            spark, [(t.exp_dir, t.experiment, t.root) for t in targets], staging, **scan_options
        )
        found = scan.files.drop("experiment").join(names, "exp_dir")
        counted = dry_run_counts(found, names)
        return local_frame(spark, counted.collect(), _COUNTS)

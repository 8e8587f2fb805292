"""Recording a scan: a first full snapshot, or what changed since the last one."""

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exp_dir_name, filename, parent_path
from ..operators.diff import COMPARED, snapshot_diff
from ..schema import BASE, COMMIT_SCHEMA, DELTA, REMOVED
from ..sources.filesystem import resolve_roots, scan_roots
from ..sources.local import local_frame, strings
from ..sources.log import LogStore, Snapshot, commit_rows, new_write, spread, timestamp_now

# Functions of the path: kept out of the shuffle and computed again after it.
_DERIVED = ("parent_path", "filename")


class Change(NamedTuple):
    exp_dir: str
    added: int
    modified: int
    removed: int
    error: str | None = None


def record_snapshot(
    store: LogStore,
    inventory: DataFrame,
    targets: Sequence[tuple[str, str | None]] | None = None,
    snapshot_ts: str | None = None,
    compare: Sequence[str] = COMPARED,
    max_removed_fraction: float | None = None,
    errors: DataFrame | None = None,
    write: str | None = None,
    staged: bool = False,
) -> list[Change]:
    """Appends one inventory of any number of experiments as a single commit.

    ``targets`` names every scanned (exp_dir, root), including experiments whose
    scan found nothing; by default the experiments of the inventory. Experiments
    without a base get one, the others a delta; those without changes get nothing.
    Where a root is known, only entries below it count as removed. With
    ``max_removed_fraction``, an experiment losing a larger share of its files is
    left as it was and reported with an error. ``errors`` (exp_dir, path) names what
    the scan could not read: an experiment with an unreadable root is left as it was,
    and nothing below another unreadable path counts as removed.

    A snapshot must be newer than all others of its experiments, or it would never be read.
    ``write`` names the folder of this write, new by default. The inventory is evaluated
    once, into a staging table that counting, range bounds and the diff read; ``staged``
    says that it is such a table already.
    """
    write = write or new_write()
    if not staged:
        with store.staging() as staging:
            inventory = staging.write(inventory, "inventory")
            return record_snapshot(
                store, inventory, targets, snapshot_ts, compare, max_removed_fraction, errors, write, True
            )
    found = {r.exp_dir: r["count"] for r in inventory.groupBy("exp_dir").count().collect()}
    if None in found:
        raise ValueError(f"{found[None]} entries without exp_dir")
    if targets is None:
        targets = [(exp_dir, None) for exp_dir in found]
    unread = _unread_roots(store, errors, targets)
    if unread:
        rest = [t for t in targets if t[0] not in unread]
        inventory = _only(store, inventory, {e for e, _ in rest}, unread)
        done = record_snapshot(
            store, inventory, rest, snapshot_ts, compare, max_removed_fraction, errors, write, True
        )
        left = [Change(e, 0, 0, 0, f"unreadable root: {r}") for e, r in unread.items()]
        return sorted(done + left)
    if not targets:
        return []
    roots = _roots(targets)
    if snapshot_ts is None:
        snapshot_ts = timestamp_now()
    newest = store.newest(roots)
    if newest is not None and newest >= snapshot_ts:
        raise ValueError(f"snapshot {snapshot_ts} is not after {newest}")

    live = store.live(roots)
    known = live.exp_dirs
    fresh = roots.keys() - known

    measured = []
    if fresh:
        rows = _only(store, inventory, fresh, known).withColumns(
            {
                "indexed_at": F.lit(snapshot_ts),
                "on_disk": F.lit(True),
                "status": F.lit(None).cast("string"),
            }
        )
        store.write_base(rows, write, snapshot_ts, sum(found.get(e, 0) for e in fresh))
        measured += store.measure_base(write, snapshot_ts)
    if known:
        n_rows = live.n_rows + sum(found.get(e, 0) for e in known)
        previous = _below_roots(store, live.state_by_key(n_rows), targets, known)
        current = spread(_only(store, inventory, known, fresh), n_rows)
        changes = snapshot_diff(
            previous.drop("indexed_at", *_DERIVED),
            current.drop(*_DERIVED),
            compare=compare,
        )
        if errors is not None and not errors.isEmpty():
            changes = _readable(changes, errors)
        rows = changes.withColumns(
            {
                "parent_path": parent_path(F.col("path")),
                "filename": filename(F.col("path")),
                "indexed_at": F.lit(snapshot_ts),
                "on_disk": F.lit(None).cast("boolean"),
            }
        )
        measured += store.write_delta(rows, write, snapshot_ts, known)

    refused: dict[str, str] = {}
    if max_removed_fraction is not None and known:
        refused = _refused(previous, measured, max_removed_fraction)
    kept = [m for m in measured if m.exp_dir not in refused]
    for exp_dir in refused:
        store.storage.delete(store.snapshot_dir(Snapshot(exp_dir, DELTA, snapshot_ts, write)))
    if kept:
        rows = [row for m in kept for row in commit_rows("add", [m], root=roots[m.exp_dir])]
        store.commit(local_frame(store.spark, rows, COMMIT_SCHEMA))
    else:
        store.discard(write)
    counts = {m.exp_dir: (m.n_added, m.n_modified, m.n_removed) for m in kept}
    return [
        Change(e, *counts.get(e, (0, 0, 0)), refused.get(e)) for e in sorted(roots)
    ]


def _roots(targets: Sequence[tuple[str, str | None]]) -> dict[str, str | None]:
    """The root of each experiment; unknown where it has several."""
    roots: dict[str, str | None] = {}
    for exp_dir, root in targets:
        roots[exp_dir] = root if roots.get(exp_dir, root) == root else None
    return roots


def _unread_roots(store: LogStore, errors: DataFrame | None, targets) -> dict[str, str]:
    """Experiments of which a root itself could not be read; at most one row per target."""
    named = [(e, r) for e, r in targets if r is not None]
    if errors is None or not named:
        return {}
    wanted = local_frame(store.spark, named, strings("exp_dir", "path"))
    rows = errors.select("exp_dir", "path").join(wanted, ["exp_dir", "path"]).distinct().collect()
    return {r.exp_dir: r.path for r in rows}


def _readable(changes: DataFrame, errors: DataFrame) -> DataFrame:
    """Changes without the removals at or below an unreadable path.

    Every removal meets the errors by its own path and those of its ancestors, so this is an
    equi-join of the removals alone.
    """
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    removed = changes.filter(F.col("status") == REMOVED).select(
        "exp_dir", "path", F.explode(above).alias("above")
    )
    bad = errors.select("exp_dir", F.col("path").alias("above")).distinct()
    unsure = removed.join(bad, ["exp_dir", "above"], "left_semi").select("exp_dir", "path").distinct()
    return changes.join(
        unsure.withColumn("status", F.lit(REMOVED)), ["exp_dir", "path", "status"], "left_anti"
    ).select(*changes.columns)


def counts_by_root(
    store: LogStore, write: str, snapshot_ts: str, targets: Sequence[tuple[str, str]]
) -> dict[tuple[str, str], tuple[int, int, int]]:
    """Numbers of added, modified and removed below each of several roots of one experiment."""
    roots = [(e, r, r.rstrip("/") + "/") for e, r in targets]
    wanted = local_frame(store.spark, roots, strings("_exp_dir", "root", "_prefix"))
    rows = store.read_written(write, snapshot_ts, BASE).unionByName(store.read_written(write, snapshot_ts, DELTA))
    inside = (F.col("exp_dir") == F.col("_exp_dir")) & F.col("path").startswith(F.col("_prefix"))
    status = F.col("status")
    counted = rows.join(wanted, inside).groupBy("exp_dir", "root").agg(
        F.count_if(status.isNull() | (status == "added")).alias("added"),
        F.count_if(status == "modified").alias("modified"),
        F.count_if(status == "removed").alias("removed"),
    )
    return {(r.exp_dir, r.root): (r.added, r.modified, r.removed) for r in counted.collect()}


def _only(
    store: LogStore, rows: DataFrame, wanted: Iterable[str], others: Iterable[str]
) -> DataFrame:
    """Rows of the wanted experiments; unchanged when there are no others."""
    if not others:
        return rows
    names = local_frame(store.spark, [(e,) for e in wanted], strings("exp_dir"))
    return rows.join(names, "exp_dir", "left_semi")


def _below_roots(store: LogStore, state: DataFrame, targets, exp_dirs: set[str]) -> DataFrame:
    """State rows under a scanned root of their experiment; all of them where none is known."""
    prefixes = [(e, "" if r is None else r.rstrip("/") + "/") for e, r in targets if e in exp_dirs]
    scanned = local_frame(store.spark, prefixes, strings("_exp_dir", "_prefix"))
    inside = (F.col("exp_dir") == F.col("_exp_dir")) & F.col("path").startswith(F.col("_prefix"))
    return state.join(scanned, inside, "left_semi")


def _refused(previous: DataFrame, measured, limit: float) -> dict[str, str]:
    losing = [m for m in measured if m.n_removed]
    if not losing:
        return {}
    counts = previous.filter("on_disk").groupBy("exp_dir").count().collect()
    on_disk = {r.exp_dir: r["count"] for r in counts}
    return {
        m.exp_dir: f"{m.n_removed} of {on_disk[m.exp_dir]} files would be removed"
        for m in losing
        if m.n_removed > limit * on_disk[m.exp_dir]
    }


def snapshot_tree(
    store: LogStore,
    root: str,
    experiment: str | None = None,
    compute_checksum: bool = False,
    workers: int | None = None,
    batch_size: int = 10_000,
    **options,
) -> Change:
    """Scans one directory tree and records it. A missing root is an error, not a purge."""
    spark = store.spark
    given = local_frame(spark, [(experiment, root)], strings("experiment", "root"))
    target = (
        resolve_roots(spark, given)
        .withColumn("exp_dir", exp_dir_name(F.col("experiment"), F.col("root")))
        .first()
    )
    if target.error:
        raise NotADirectoryError(target.error)
    with store.staging() as staging:
        scan = scan_roots(
            spark,
            [(target.exp_dir, experiment, target.root)],
            staging,
            compute_checksum,
            workers,
            batch_size,
        )
        targets = [(target.exp_dir, target.root)]
        return record_snapshot(store, scan.files, targets, errors=scan.errors, staged=True, **options)[0]

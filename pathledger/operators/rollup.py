"""Totals per directory, and listings, trees and statistics that add them up.

A directory's totals count the entries directly in it. A snapshot's totals are signed: what
the snapshot adds to those of the snapshots before it, so the totals of all live snapshots
add up to those of the current state.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import child_name, directory_prefix, resolve_on_disk
from ..schema import DELTA, KEY, REMOVED, TOTALS

DIRECTORY = ["exp_dir", "directory"]


def _counted(on_disk: Column) -> dict[str, Column]:
    """What one entry adds to its directory."""
    size = F.coalesce(F.col("size"), F.lit(0))
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    values = (one, size, F.when(on_disk, one).otherwise(zero), F.when(on_disk, size).otherwise(zero))
    return dict(zip(TOTALS, values, strict=True))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOTALS]


def directory_totals(state: DataFrame) -> DataFrame:
    """Totals of a state or a base: (exp_dir, directory) and the four totals."""
    on_disk = resolve_on_disk(F.col("on_disk"))
    entries = state.select("exp_dir", F.col("parent_path").alias("directory"), "size", on_disk.alias("on_disk"))
    return entries.withColumns(_counted(F.col("on_disk"))).groupBy(*DIRECTORY).agg(*_sums())


def signed_totals(history: DataFrame) -> DataFrame:
    """Signed totals of every delta: ``snapshot_ts`` beside the columns of :func:`directory_totals`.

    ``history`` holds the delta rows of some experiments with the base rows of the same keys,
    others may be left out. One window per key compares each version with the one before, by
    the rules of :func:`replay`: a removal keeps the size it names, a removal of what was never
    known counts nothing. A window holds at most one row per live snapshot.
    """
    order = Window.partitionBy(*KEY).orderBy("snapshot_ts", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.max(~F.col("status").eqNullSafe(REMOVED)).over(so_far)
    rows = history.select(
        *KEY, "parent_path", "size", "kind", "snapshot_ts",
        resolve_on_disk(F.col("on_disk"), F.col("status")).alias("on_disk"), known.alias("known"),
    )
    now = {c: F.when(F.col("known"), v).otherwise(F.lit(0).cast("long")) for c, v in _counted(F.col("on_disk")).items()}
    rows = rows.withColumns(now)
    before = {f"_{c}": F.lag(c, 1, 0).over(order) for c in TOTALS}
    changes = rows.withColumns(before).filter(F.col("kind") == DELTA)
    signed = changes.select(
        "exp_dir", "snapshot_ts", F.col("parent_path").alias("directory"),
        *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in TOTALS],
    )
    summed = signed.groupBy("exp_dir", "snapshot_ts", "directory").agg(*_sums())
    return summed.filter(" OR ".join(f"{c} <> 0" for c in TOTALS))


def rolled_stats(totals: DataFrame) -> DataFrame:
    """As :func:`catalog_stats`, from totals."""
    return totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_count", "on_disk_count", "total_size", "on_disk_size")])


def rolled_directories(totals: DataFrame, path: str, on_disk_only: bool = False) -> DataFrame:
    """As :func:`list_directories`, from totals; sizes that are all NULL sum to 0."""
    prefix = directory_prefix(path)
    count, size = ("on_disk_count", "on_disk_size") if on_disk_only else ("total_count", "total_size")
    return (
        totals.filter(F.col("directory").startswith(prefix))
        .groupBy(child_name(F.col("directory"), prefix).alias("dirname"))
        .agg(F.sum(size).alias("total_size"), F.sum(count).alias("file_count"))
        .filter("dirname <> '' AND file_count > 0")
        .orderBy("dirname")
    )


def directory_level(directory: Column, path: str) -> Column:
    """Levels of a directory below ``path``; 0 for ``path`` itself, NULL outside."""
    prefix = directory_prefix(path)
    rest = F.substring(directory, F.lit(len(prefix) + 1), F.length(directory))
    inside = F.when(directory.startswith(prefix), F.size(F.split(rest, "/")))
    return F.when(directory == (path.rstrip("/") or "/"), F.lit(0)).otherwise(inside)


def rolled_nodes(totals: DataFrame, files: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """As :func:`tree_nodes`: directories from totals, files from ``files``.

    ``files`` need only hold the entries of directories less than ``depth`` levels below ``path``.
    """
    if depth <= 0:
        totals, files = totals.limit(0), files.limit(0)
    prefix = directory_prefix(path)
    parts = F.split(F.substring("directory", F.lit(len(prefix) + 1), F.length("directory")), "/")
    deepest = (
        totals.filter(F.col("directory").startswith(prefix))
        .select(F.slice(parts, F.lit(1), F.least(F.size(parts), F.lit(depth))).alias("parts"), "on_disk_count", "on_disk_size")
        .groupBy("parts")
        .agg(F.sum("on_disk_count").alias("_n"), F.sum("on_disk_size").alias("_size"))
        .filter("_n > 0")
    )
    ancestors = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i))
    directories = (
        deepest.select("_n", "_size", F.explode(ancestors).alias("parts"))
        .groupBy("parts")
        .agg(F.sum("_n").alias("file_count"), F.sum("_size").alias("total_size"))
        .select("parts", F.lit(True).alias("is_dir"), "file_count", "total_size")
    )
    own = F.split(F.substring("path", F.lit(len(prefix) + 1), F.length("path")), "/")
    shown = (
        files.filter(F.col("on_disk") & F.col("path").startswith(prefix))
        .select(own.alias("parts"), "size")
        .filter(F.size("parts") <= depth)
        .groupBy("parts")
        .agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))
        .select("parts", F.lit(False).alias("is_dir"), "file_count", "total_size")
    )
    return directories.unionByName(shown).filter(F.try_element_at("parts", F.lit(-1)) != "")

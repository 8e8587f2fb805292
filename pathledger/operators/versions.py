"""Replaying the change log: which snapshots count, and what they amount to."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import resolve_on_disk
from ..schema import BASE, DELTA, KEY, REMOVED


def snapshot_summary(log: DataFrame) -> DataFrame:
    """One row per snapshot of a log with its number of records."""
    return log.groupBy("exp_dir", "kind", "snapshot_ts").agg(
        F.count("*").alias("record_count")
    )


def latest_base(snapshots: DataFrame) -> DataFrame:
    """Newest base of each experiment as (exp_dir, base_ts)."""
    return (
        snapshots.filter(F.col("kind") == BASE)
        .groupBy("exp_dir")
        .agg(F.max("snapshot_ts").alias("base_ts"))
    )


def deltas_after_base(snapshots: DataFrame) -> DataFrame:
    """Deltas newer than the newest base; an experiment without a base has none."""
    return (
        snapshots.filter(F.col("kind") == DELTA)
        .join(latest_base(snapshots), "exp_dir")
        .filter("snapshot_ts > base_ts")
        .drop("base_ts")
    )


def live_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshots that make up the current state: newest base and later deltas."""
    bases = latest_base(snapshots)
    return (
        snapshots.join(bases, "exp_dir")
        .filter(
            ((F.col("kind") == BASE) & (F.col("snapshot_ts") == F.col("base_ts")))
            | ((F.col("kind") == DELTA) & (F.col("snapshot_ts") > F.col("base_ts")))
        )
        .drop("base_ts")
    )


def state_columns(log: DataFrame) -> list[str]:
    """Columns of a state: those of the log less what tells versions apart."""
    return [c for c in log.columns if c not in ("status", "kind", "snapshot_ts")]


def newest_rows(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Last row of every key; at equal times a delta outranks a base."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc("indexed_at"), F.desc("kind"), F.desc("snapshot_ts")
    )
    return log.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def replay(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Current state of live log rows, removed entries included.

    The newest row of a key counts; a removal row carries the metadata it ends, and
    is ignored where the path was never known. One shuffle and one sort on the key
    serve both window expressions, and columns nobody asks for stay out of them.
    """
    newest = (
        _newest_versions(log, keys)
        .filter("_known")
        .withColumn("on_disk", resolve_on_disk(F.col("on_disk"), F.col("status")))
    )
    return newest.select(*state_columns(log))


def merge_on_read(
    base: DataFrame,
    deltas: DataFrame,
    keys: Sequence[str] = KEY,
    broadcast_keys: bool = False,
) -> DataFrame:
    """Current state without shuffling the base, for logs written by this library.

    Base rows whose key a delta mentions are dropped; the newest delta row of each key
    takes their place. Rows order as in :func:`replay`, and a removal whose path neither
    the base nor another delta row knows is ignored as there, so both give the same rows.
    Whether the base knows a removed path takes one more scan of its keys alone.
    ``broadcast_keys`` is for callers that have checked the size of the keys;
    without it Spark chooses the join from its own size estimates.
    """
    small = F.broadcast if broadcast_keys else (lambda frame: frame)
    newest = _newest_versions(deltas, keys)
    columns = state_columns(base)
    kept = base.join(small(deltas.select(*keys)), list(keys), "left_anti").withColumn(
        "on_disk", resolve_on_disk(F.col("on_disk"))
    )
    replaced = newest.withColumn("on_disk", resolve_on_disk(F.col("on_disk"), F.col("status")))
    known = replaced.filter("_known")
    # The base is the streamed side; a key occurs in it once.
    removed = small(replaced.filter("NOT _known"))
    ended = base.select(*keys).join(removed, list(keys)).dropDuplicates(list(keys))
    return (
        kept.select(*columns)
        .unionByName(known.select(*columns))
        .unionByName(ended.select(*columns))
    )


def _newest_versions(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row of every key, and whether any of its rows is more than a removal."""
    order = Window.partitionBy(*keys).orderBy(F.desc("snapshot_ts"), F.desc("kind"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.max(~F.col("status").eqNullSafe(REMOVED)).over(whole)
    return log.withColumns({"_known": known, "_rn": F.row_number().over(order)}).filter("_rn = 1")

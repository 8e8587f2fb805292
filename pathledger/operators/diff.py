"""Comparing a scan with the previous state.

``previous`` carries ``on_disk``; ``current`` does not. Both hold one row per
key, so the key itself cannot be skewed, and every variant is one equi-join.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entry_changed
from ..schema import ADDED, KEY, MODIFIED, REMOVED

COMPARED = ("size", "mtime")


def snapshot_diff(
    previous: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = KEY,
    compare: Sequence[str] = COMPARED,
) -> DataFrame:
    """Changes that lead from ``previous`` to ``current``, with a ``status`` column.

    Entries already gone from disk are dropped before the join: met again they
    count as added, as an unknown path does, and absent they change nothing. The
    join therefore does not grow with the history of removed files. A removed
    row carries the previous metadata, any other row the current one.
    """
    details = [c for c in current.columns if c not in keys]
    before = previous.filter("on_disk").select(*keys, F.struct(*details).alias("_before"))
    now = current.select(*keys, F.struct(*details).alias("_now"))
    status = (
        F.when(F.col("_before").isNull(), ADDED)
        .when(F.col("_now").isNull(), REMOVED)
        .when(entry_changed(F.col("_now"), F.col("_before"), compare), MODIFIED)
    )
    return (
        before.join(now, list(keys), "full_outer")
        .select(*keys, F.coalesce("_now", "_before").alias("_row"), status.alias("status"))
        .filter("status IS NOT NULL")
        .select(*keys, "_row.*", "status")
    )


def added_entries(
    previous: DataFrame, current: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Current entries whose key was never seen."""
    return current.join(previous.select(*keys), list(keys), "left_anti")


def restored_entries(
    previous: DataFrame, current: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Current entries that were known as removed."""
    return current.join(previous.filter("NOT on_disk").select(*keys), list(keys), "left_semi")


def removed_entries(
    previous: DataFrame, current: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Previous entries on disk that the scan no longer meets, with their old metadata."""
    return previous.filter("on_disk").join(current.select(*keys), list(keys), "left_anti")


def modified_entries(
    previous: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = KEY,
    compare: Sequence[str] = COMPARED,
) -> DataFrame:
    """Current entries that were on disk with other values of ``compare``."""
    before = previous.filter("on_disk").select(*keys, F.struct(*compare).alias("_before"))
    now = F.struct(*compare)
    return (
        current.join(before, list(keys))
        .filter(entry_changed(now, F.col("_before"), compare))
        .drop("_before")
    )


def change_counts(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Numbers of added, modified and removed entries, optionally per group."""
    counts = [
        F.count_if(F.col("status") == s).alias(s) for s in (ADDED, MODIFIED, REMOVED)
    ]
    return changes.groupBy(*by).agg(*counts)

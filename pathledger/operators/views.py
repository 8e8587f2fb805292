"""The ``files`` relation built straight from log rows, without commit metadata."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import resolve_on_disk
from ..schema import KEY
from .versions import newest_rows, state_columns


def files_view(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Newest row per key over all bases and deltas.

    ``keys=["path"]`` gives one row per path across experiments; the default
    keeps overlapping experiments apart, whatever their layout.
    """
    return (
        newest_rows(log, keys)
        .withColumn("on_disk", resolve_on_disk(F.col("on_disk"), F.col("status")))
        .select(*state_columns(log))
    )


def files_view_base_only(bases: DataFrame) -> DataFrame:
    """View of experiments without deltas: a plain scan, no shuffle."""
    return bases.withColumn("on_disk", resolve_on_disk(F.col("on_disk"))).select(
        *state_columns(bases)
    )


def files_view_selective(
    log: DataFrame, changing: Iterable[str], keys: Sequence[str] = KEY
) -> DataFrame:
    """Deduplicate only the ``changing`` experiments, those that have deltas; pass the others through.

    Commits know their names, so the log is not asked for them: it is read once for
    each half.
    """
    has_deltas = F.col("exp_dir").isin(list(changing))
    return files_view_base_only(log.filter(~has_deltas)).unionByName(
        files_view(log.filter(has_deltas), keys)
    )

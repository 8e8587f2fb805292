"""Totals over the ``files`` relation, each in one pass with partial sums."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_regular_file


def count_files(files: DataFrame, on_disk_only: bool = False) -> DataFrame:
    if on_disk_only:
        files = files.filter("on_disk")
    return files.agg(F.count("*").alias("file_count"))


def total_size(files: DataFrame, on_disk_only: bool = False) -> DataFrame:
    if on_disk_only:
        files = files.filter("on_disk")
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def catalog_stats(files: DataFrame) -> DataFrame:
    """Numbers and sizes of all entries and of those on disk; zeros when empty."""
    on_disk_size = F.sum(F.when(F.col("on_disk"), F.col("size")))
    return files.agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("on_disk")).alias("on_disk_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(on_disk_size, F.lit(0)).alias("on_disk_size"),
    )


def dry_run_counts(scan: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Regular files per hutch and experiment; targets without any count as 0."""
    by = ["hutch", "experiment"]
    counts = (
        scan.filter(is_regular_file(F.col("permissions")))
        .groupBy(*by)
        .agg(F.count("*").alias("file_count"))
    )
    if targets is None:
        return counts
    return targets.select(*by).join(counts, by, "left").fillna(0, ["file_count"])

"""Listing one directory and summing up its children."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import child_name, directory_prefix


def below(path: str) -> Column:
    """True for entries anywhere under a directory.

    ``path`` is a key of every deduplication, so this condition moves below it
    and reaches the Parquet scan, where files sorted by path can skip most pages.
    """
    return F.col("path").startswith(directory_prefix(path))


def list_directory(files: DataFrame, path: str, on_disk_only: bool = False) -> DataFrame:
    """Entries whose parent is exactly ``path``, by name."""
    entries = files.filter(F.col("parent_path") == path)
    if path != ".":
        entries = entries.filter(below(path))
    if on_disk_only:
        entries = entries.filter("on_disk")
    return entries.orderBy("filename")


def list_directories(files: DataFrame, path: str, on_disk_only: bool = False) -> DataFrame:
    """Immediate subdirectories with the size and number of all files below them.

    The prefix is literal text, so ``_`` and ``%`` in names mean themselves.
    """
    prefix = directory_prefix(path)
    entries = files.filter(below(path) & F.col("parent_path").startswith(prefix))
    if on_disk_only:
        entries = entries.filter("on_disk")
    return (
        entries.groupBy(child_name(F.col("parent_path"), prefix).alias("dirname"))
        .agg(F.sum("size").alias("total_size"), F.count("*").alias("file_count"))
        .filter("dirname <> ''")
        .orderBy("dirname")
    )

"""Filtered search over the ``files`` relation."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extension as extension_of
from ..functions import is_symlink, like_literal


def find(
    files: DataFrame,
    pattern: str = "%",
    size_gt: int | None = None,
    size_lt: int | None = None,
    experiment: str | None = None,
    exclude: Iterable[str] | None = None,
    on_disk_only: bool = False,
    removed_only: bool = False,
    skip_symlinks: bool = False,
    extension: str | None = None,
    regex: str | None = None,
    fuzzy: tuple[str, int] | None = None,
    mtime_from: int | None = None,
    mtime_to: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Entries that meet every given condition, by path.

    ``pattern`` and ``exclude`` are LIKE patterns on the whole path, case-sensitive,
    without an escape character. Size bounds are strict; ``mtime_from`` is
    inclusive and ``mtime_to`` exclusive. ``fuzzy`` is a term and the largest edit
    distance of a file name from it. ``ordered=False`` saves the global sort where
    the result goes on into another job.
    """
    path = F.col("path")
    conditions: list[Column] = [path.like(like_literal(pattern))]
    conditions += [~path.like(like_literal(p)) for p in exclude or ()]
    if size_gt is not None:
        conditions.append(F.col("size") > size_gt)
    if size_lt is not None:
        conditions.append(F.col("size") < size_lt)
    if experiment is not None:
        conditions.append(F.col("experiment") == experiment)
    if on_disk_only:
        conditions.append(F.col("on_disk"))
    if removed_only:
        conditions.append(~F.col("on_disk"))
    if skip_symlinks:
        conditions.append(~is_symlink(F.col("permissions")))
    if extension is not None:
        conditions.append(extension_of(F.col("filename")) == extension.lstrip("."))
    if regex is not None:
        conditions.append(path.rlike(regex))
    if fuzzy is not None:
        term, distance = fuzzy
        conditions.append(F.levenshtein("filename", F.lit(term)) <= distance)
    if mtime_from is not None:
        conditions.append(F.col("mtime") >= mtime_from)
    if mtime_to is not None:
        conditions.append(F.col("mtime") < mtime_to)
    for condition in conditions:
        files = files.filter(condition)
    return files.orderBy("path") if ordered else files


def with_status(entries: DataFrame, column: str = "state") -> DataFrame:
    """Adds ``[removed]`` for entries no longer on disk, empty text for the others."""
    return entries.withColumn(column, F.when(~F.col("on_disk"), "[removed]").otherwise(""))


def as_entries(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Result columns of ls and find; a column the relation lacks becomes NULL text."""
    return files.select(
        *[F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )

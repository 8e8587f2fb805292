"""Expressions over path text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename(path: Column) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Text before the last ``/``; ``/`` for a file at the root, ``.`` without any ``/``."""
    cut = F.length(path) - F.length(filename(path)) - 1
    return (
        F.when(cut < 0, F.lit("."))
        .when(cut == 0, F.lit("/"))
        .otherwise(F.substring(path, F.lit(1), cut))
    )


def run_number(path: Column) -> Column:
    """First ``run<digits>`` anywhere in the path; NULL when absent or beyond INT."""
    digits = F.regexp_extract(path, r"run(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def extension(name: Column) -> Column:
    """Text after the last dot of a file name, without the dot; empty if there is none."""
    return F.regexp_extract(name, r"\.([^.]+)$", 1)


def exp_dir_name(experiment: Column, root: Column) -> Column:
    """Partition name of an experiment: its own name, else 8 hex digits of md5(root)."""
    return F.coalesce(
        F.nullif(experiment, F.lit("")), F.substring(F.md5(root.cast("binary")), 1, 8)
    )


def directory_prefix(path: str) -> str:
    """The literal prefix shared by everything below a directory."""
    return path.rstrip("/") + "/"


def child_name(directory: Column, prefix: str) -> Column:
    """The path component that follows ``prefix``."""
    rest = F.substring(directory, F.lit(len(prefix) + 1), F.length(directory))
    return F.substring_index(rest, "/", 1)


def like_literal(pattern: str) -> str:
    """A LIKE pattern in which a backslash is an ordinary character."""
    return pattern.replace("\\", "\\\\")

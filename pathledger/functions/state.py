"""Expressions over an entry's state: type bits, presence, change."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import REMOVED, S_IFLNK, S_IFMT, S_IFREG


def is_symlink(permissions: Column) -> Column:
    return permissions.bitwiseAND(F.lit(S_IFMT)) == S_IFLNK


def is_regular_file(permissions: Column) -> Column:
    return permissions.bitwiseAND(F.lit(S_IFMT)) == S_IFREG


def resolve_on_disk(on_disk: Column, status: Column | None = None) -> Column:
    """Presence of an entry: the stored flag, else what its status implies, else true."""
    if status is None:
        return F.coalesce(on_disk, F.lit(True))
    return F.coalesce(on_disk, status != REMOVED, F.lit(True))


def entry_changed(current: Column, previous: Column, fields: Sequence[str]) -> Column:
    """True where any of ``fields`` differs between two structs; NULL equals NULL."""
    same = [current[f].eqNullSafe(previous[f]) for f in fields]
    return ~reduce(lambda a, b: a & b, same)

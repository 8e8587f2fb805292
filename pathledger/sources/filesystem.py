"""Scanning directory trees that every executor mounts at the same path.

The walk is a series of rounds over a frontier table of directories; listing,
``lstat`` and hashing run in Arrow-batched Python tasks, since no Spark source
reports ownership, mode and links. Each round is a written table: a directory is
listed once, and a retry of a later step works on what was seen then.
"""

import hashlib
import os
import sys
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exp_dir_name
from .inventory import from_table
from .local import local_frame, strings
from .storage import Staging

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Directories a task lists for each one it was given, before it hands on the rest.
FIRST_BUDGET, BUDGET_GROWTH, LARGEST_BUDGET = 1, 8, 4096
FILES_PER_TASK = 20_000
ROWS_PER_BATCH = 10_000
HASH_CHUNK = 1 << 20

_FOUND = T.StructType(
    [
        T.StructField("exp_dir", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("found", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
_STATTED = T.StructType(
    [
        T.StructField("exp_dir", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("owner", T.StringType()),
        T.StructField("group_name", T.StringType()),
        T.StructField("permissions", T.IntegerType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
_TARGETS = T.StructType(
    [
        T.StructField("hutch", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class ScanResult(NamedTuple):
    files: DataFrame  # inventory columns with exp_dir
    errors: DataFrame  # (exp_dir, path, error) of what could not be read


def _batches(rows: Iterable[tuple], schema: T.StructType, size: int) -> Iterator[pd.DataFrame]:
    names = schema.names
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _frame(held, names)
            held = []
    if held:
        yield _frame(held, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    # Object columns keep 64-bit integers exact beside NULLs.
    return pd.DataFrame.from_records(rows, columns=names).astype(object)


def _encodable(path: str) -> bool:
    try:
        path.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def _list_below(exp_dir: str, top: str, budget: int) -> Iterator[tuple]:
    """Files under ``top`` from at most ``budget`` directories, then the unlisted ones.

    A link to a directory is an entry of its own and is not followed.
    """
    pending = deque([top])
    while pending and budget > 0:
        budget -= 1
        directory = pending.popleft()
        try:
            with os.scandir(directory) as entries:
                for entry in entries:
                    try:
                        is_dir = entry.is_dir(follow_symlinks=False)
                    except OSError as error:
                        yield exp_dir, entry.path, "error", str(error)
                        continue
                    if not _encodable(entry.path):
                        shown = entry.path.encode("utf-8", "replace").decode("utf-8")
                        yield exp_dir, shown, "error", "name is not UTF-8"
                    elif is_dir:
                        pending.append(entry.path)
                    else:
                        yield exp_dir, entry.path, "file", None
        except OSError as error:
            yield exp_dir, directory, "error", str(error)
    for directory in pending:
        yield exp_dir, directory, "dir", None


def _list_frontier(budget: int, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            row
            for frame in frames
            for exp_dir, path in zip(frame["exp_dir"], frame["path"])
            for row in _list_below(exp_dir, path, budget)
        )
        yield from _batches(rows, _FOUND, batch)

    return run


def _sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as content:
        while chunk := content.read(HASH_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _stat_one(exp_dir: str, path: str, checksum: bool) -> tuple:
    try:
        info = os.lstat(path)
    except OSError as error:
        return exp_dir, path, None, None, None, None, None, None, str(error)
    digest, problem = None, None
    if checksum:
        try:
            # Follows links to files; a broken link or a special file has no content.
            if os.path.isfile(path):
                digest = _sha256(path)
        except OSError as error:
            problem = str(error)
    return (
        exp_dir, path, info.st_size, int(info.st_mtime), str(info.st_uid), str(info.st_gid),
        info.st_mode, digest, problem,
    )


def _stat_all(checksum: bool, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            _stat_one(exp_dir, path, checksum)
            for frame in frames
            for exp_dir, path in zip(frame["exp_dir"], frame["path"])
        )
        yield from _batches(rows, _STATTED, batch)

    return run


def scan_roots(
    spark: SparkSession,
    targets: list[tuple[str, str | None, str]],
    staging: Staging,
    compute_checksum: bool = False,
    workers: int | None = None,
    batch_size: int = ROWS_PER_BATCH,
) -> ScanResult:
    """Lists every non-directory below the roots and reads its metadata.

    ``targets`` holds (exp_dir, experiment, root). Small trees end within their
    first rounds; large ones spread, as each task passes on the directories beyond
    its growing budget. Metadata is read after a reshuffle by path, so one
    directory with most of the files still occupies every task. An unreadable entry
    becomes an error row; one whose content alone is unreadable keeps its metadata.
    """
    tasks = workers or 2 * spark.sparkContext.defaultParallelism
    if not targets:
        raise ValueError("no roots to scan")
    frontier = local_frame(spark, [(e, r) for e, _, r in targets], strings("exp_dir", "path"))
    width = len(targets)
    found, budget, level = None, FIRST_BUDGET, 0
    while True:
        listed = frontier.repartition(min(tasks, width), "path").mapInPandas(
            _list_frontier(budget, batch_size), _FOUND
        )
        listed = staging.write(listed, f"walk-{level}")
        found = listed if found is None else found.unionByName(listed)
        frontier = listed.filter("found = 'dir'").select("exp_dir", "path")
        width = frontier.count()
        if not width:
            break
        budget, level = min(budget * BUDGET_GROWTH, LARGEST_BUDGET), level + 1

    entries = found.filter("found = 'file'").select("exp_dir", "path")
    n_files = entries.count()
    width = max(1, min(tasks, n_files), -(-n_files // FILES_PER_TASK))
    statted = staging.write(
        entries.repartition(width, "exp_dir", "path").mapInPandas(
            _stat_all(compute_checksum, batch_size), _STATTED
        ),
        "stat",
    )
    names = local_frame(
        spark, [(e, x) for e, x, _ in targets], strings("exp_dir", "experiment")
    ).distinct()
    files = from_table(statted.filter("permissions IS NOT NULL").drop("error").join(names, "exp_dir"))
    errors = (
        found.filter("found = 'error'")
        .select("exp_dir", "path", "error")
        .unionByName(statted.filter("error IS NOT NULL").select("exp_dir", "path", "error"))
    )
    return ScanResult(files, errors)


def resolve_roots(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """Replaces ``root`` by its real path and sets ``error`` where it is no directory."""
    schema = T.StructType(
        [f for f in roots.schema if f.name != "error"] + [T.StructField("error", T.StringType())]
    )

    def run(frames):
        for frame in frames:
            real = [os.path.realpath(r) for r in frame["root"]]
            error = [None if os.path.isdir(r) else f"not a directory: {r}" for r in real]
            yield frame.assign(root=real, error=pd.Series(error, dtype=object, index=frame.index))

    return roots.mapInPandas(run, schema)


def discover_experiments(spark: SparkSession, data_root: str, hutches: list[str]) -> DataFrame:
    """One row per experiment directory of each hutch: hutch, experiment, root, error, exp_dir.

    A hutch without a directory yields one row with an error and no experiment.
    Names beginning with a dot are skipped, links to directories are followed.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for hutch in frame["hutch"]:
                top = os.path.join(data_root, hutch)
                try:
                    names = sorted(os.listdir(top))
                except OSError as error:
                    rows.append((hutch, None, top, str(error)))
                    continue
                for name in names:
                    path = os.path.join(top, name)
                    if not name.startswith(".") and os.path.isdir(path):
                        rows.append((hutch, name, os.path.realpath(path), None))
            yield pd.DataFrame(rows, columns=_TARGETS.names, dtype=object)

    hutch_rows = local_frame(spark, [(h,) for h in hutches], strings("hutch"))
    found = hutch_rows.repartition(max(1, len(hutches)), "hutch").mapInPandas(run, _TARGETS)
    return found.withColumn("exp_dir", exp_dir_name(F.col("experiment"), F.col("root")))

"""File inventories derived from ``orders``: three scans, their change log and its view.

The formulas are fixed values shared with ``oracles.CTES``: every hutch is scanned three
times; in two of them files vanish, come back and change size in between.
"""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger import Catalog, from_table
from pathledger.operators import files_view, replay, snapshot_diff
from pathledger.schema import BASE, DELTA

KEYS = ["exp_dir", "path"]
FILE = ["path", "parent_path", "filename", "size", "mtime", "permissions", "experiment", "run"]
VIEW = [*FILE, "indexed_at", "on_disk"]
LOG = [*VIEW, "status"]
CHANGING = ["cxi", "mfx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(remainder, *choices: str):
    """The choice at a remainder, the last one otherwise."""
    value = F.lit(choices[-1])
    for i in range(len(choices) - 2, -1, -1):
        value = F.when(remainder == i, choices[i]).otherwise(value)
    return value


def _digits(value, width: int):
    return F.lpad(value.cast("string"), width, "0")


def inventory(spark: SparkSession, sf_dir: str, scan: int | None = None) -> DataFrame:
    """Rows of one scan, or of all three with their number ``t``."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    scans = [0, 1, 2] if scan is None else [scan]
    k, t = F.col("k"), F.col("t")
    changing = F.col("hutch").isin(CHANGING)
    hutch = _pick(k % 4, "cxi", "mfx", "xpp", "mec")
    sub = F.concat(
        _pick(k % 3, "/scratch", "/xtc", "/results"),
        F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("/run"), _digits(k % 25, 4))),
    )
    rows = (
        orders.select("*", F.explode(F.array(*[F.lit(s) for s in scans])).alias("t"))
        .withColumn("hutch", hutch)
        .filter(
            (((t == 0) | ~changing) & (k % 10 != 9))
            | (changing & (((t == 1) & (k % 7 != 3)) | ((t == 2) & (k % 13 != 5))))
        )
        .withColumn("experiment", F.concat("hutch", _digits(F.col("o_custkey") % 12, 5)))
        .withColumn("parent_path", F.concat(F.lit("/ds/"), "hutch", F.lit("/"), "experiment", sub))
        .withColumn(
            "filename",
            F.concat(F.lit("f_"), k.cast("string"), _pick(k % 5, ".h5", ".xtc2", ".npz", ".txt", ".dat")),
        )
    )
    return rows.select(
        "k",
        "t",
        "hutch",
        "experiment",
        F.concat("parent_path", F.lit("/"), "filename").alias("path"),
        "parent_path",
        "filename",
        (
            1
            + (k * 7919123) % 3000000000
            + F.when(changing & (t >= 1) & (k % 11 == 0), 1).otherwise(0)
            + F.when(changing & (t >= 2) & (k % 19 == 0), 2).otherwise(0)
        ).alias("size"),
        (1700000000 + (k * 37) % 10000000).alias("mtime"),
        F.when(k % 17 == 0, 41471).otherwise(33188).alias("permissions"),
        F.when(k % 3 == 2, None).otherwise((k % 25).cast("int")).alias("run"),
    )


def _scan(scans: DataFrame, number: int) -> DataFrame:
    """One scan of an inventory with the columns of a log."""
    rows = scans.filter(F.col("t") == number)
    return rows.select(F.col("experiment").alias("exp_dir"), *FILE)


def scan_rows(spark: SparkSession, sf_dir: str, scan: int) -> DataFrame:
    return _scan(inventory(spark, sf_dir, scan), scan)


def _stamped(rows: DataFrame, ts: str, kind: str) -> DataFrame:
    return rows.withColumns(
        {"indexed_at": F.lit(ts), "snapshot_ts": F.lit(ts), "kind": F.lit(kind)}
    )


def base_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base_log(inventory(spark, sf_dir, 0))


def _base_log(scans: DataFrame) -> DataFrame:
    rows = _stamped(_scan(scans, 0), "t0", BASE)
    return rows.withColumns({"on_disk": F.lit(True), "status": F.lit(None).cast("string")})


def delta_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the two later scans, each against the scan before it."""
    return _delta_log(inventory(spark, sf_dir))


def _delta_log(scans: DataFrame) -> DataFrame:
    earlier, second, third = (_scan(scans, t) for t in (0, 1, 2))
    there = F.lit(True)
    first_changes = snapshot_diff(earlier.withColumn("on_disk", there), second)
    second_changes = snapshot_diff(second.withColumn("on_disk", there), third)
    return (
        _stamped(first_changes, "t1", DELTA)
        .unionByName(_stamped(second_changes, "t2", DELTA))
        .withColumn("on_disk", F.lit(None).cast("boolean"))
    )


def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = inventory(spark, sf_dir)
    return _base_log(scans).unionByName(_delta_log(scans))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_view(snapshot_log(spark, sf_dir))


def state_before_last_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the second scan, removed entries included."""
    return replay(snapshot_log(spark, sf_dir).filter(F.col("snapshot_ts") < "t2"))


def scratch(spark: SparkSession) -> str:
    """A new folder on storage all executors share; machine-local only where none is named."""
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if parent is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="pathledger-")
    return os.path.join(parent, f"pathledger-{uuid.uuid4().hex}")


def record_scans(spark: SparkSession, sf_dir: str, **options):
    """A stored catalog of the three scans, and the report of the last one."""
    catalog = Catalog(spark, scratch(spark) + "/catalog", **options)
    for t in (0, 1, 2):
        scanned = from_table(inventory(spark, sf_dir, t))
        report = catalog.snapshot_table(scanned, snapshot_ts=f"t{t}")
    return catalog, report


_recorded: dict = {}


def recorded(spark: SparkSession, sf_dir: str):
    """One stored catalog per session and data set, for queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _recorded:
        _recorded[key] = record_scans(spark, sf_dir)
    return _recorded[key]

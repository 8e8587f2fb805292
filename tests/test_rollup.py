"""Directory totals against scans of the files."""

import importlib
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pathledger import Catalog, from_table
from pathledger import operators as ops
from pathledger.schema import TOTALS
from tests.test_operators import LOG, log_rows

log = importlib.import_module("pathledger.sources.log")


def scan(spark, files):
    """Inventory of (exp_dir, relative path, size)."""
    rows = [(f"/d/{e}/{p}", e, s, 1) for (e, p), s in files.items()]
    return from_table(spark.createDataFrame(rows, "path string, experiment string, size long, mtime long"))


def random_files(rnd, experiments=("a", "b")):
    names = ["top", "x/f", "x/g", "x/y/f", "x/y/z/f", "x_/f", "w/f", "w/v/f", "x/y"]
    return {(e, n): rnd.randrange(5) for e in experiments for n in names if rnd.random() < 0.6}


def answers(catalog):
    """Everything that totals may answer, in comparable form."""
    out = {"stats": catalog.get_stats()}
    out["totals"] = sorted(map(tuple, catalog.directory_totals().select("exp_dir", "directory", *TOTALS).collect()))
    for path, only in (("/d", False), ("/d/a", True), ("/d/a/x", False), ("/", True)):
        out[path, only] = [tuple(r) for r in catalog.ls_dirs(path, only).collect()]
    for path, depth in (("/d", 3), ("/d/a/", 1), ("/d/a/x", 2)):
        nodes = catalog.tree_nodes(path, depth).select("parts", "is_dir", "file_count", "total_size")
        out[path, depth] = sorted(map(tuple, nodes.collect()))
    return out


@pytest.mark.parametrize("seed", [1])
def test_totals_equal_the_scan(spark, catalog_dir, tmp_path, seed):
    rnd = random.Random(seed)
    summed, plain = Catalog(spark, catalog_dir), Catalog(spark, str(tmp_path / "plain"))
    both = (summed, plain)
    for t in range(3):
        files = random_files(rnd)
        for catalog in both:
            catalog.snapshot_table(scan(spark, files), snapshot_ts=f"t{t}")
        if t != 1:  # what one call left out, the next adds
            assert summed.sum_directories() > 0
            assert summed.sum_directories() == 0
    one = {k: v for k, v in random_files(rnd).items() if k[0] == "b"}
    for catalog in both:  # one experiment without totals, the others with
        catalog.snapshot_table(scan(spark, one), targets=[("b", None)], snapshot_ts="t4")
        catalog.consolidate(exp_dirs=["a"], snapshot_ts="t9")
    assert answers(summed) == answers(plain)
    summed.sum_directories()
    assert summed.get_stats() == plain.get_stats()


@pytest.mark.parametrize("seed", range(2))
def test_signed_totals_of_any_log(spark, seed):
    """Orphan removals, and paths that come and go: after every snapshot the sums are the state's."""
    rnd = random.Random(seed)
    rows = [("e", f"/{i % 4}/{i}", i, "t0", None) for i in range(20)]
    for n in range(1, 5):
        for i in rnd.sample(range(30), 12):
            rows.append(("e", f"/{i % 4}/{i}", 100 * n + i, f"t{n}", rnd.choice(["added", "modified", "removed"])))
    history = spark.createDataFrame(log_rows(rows), LOG).withColumn("parent_path", F.substring_index("path", "/", 2))
    base = ops.directory_totals(history.filter("kind = 'base'"))
    signed = ops.signed_totals(history).cache()
    for n in range(5):
        then = history.filter(F.col("snapshot_ts") <= f"t{n}")
        expected = ops.directory_totals(ops.replay(then))
        parts = base.unionByName(signed.filter(F.col("snapshot_ts") <= f"t{n}").drop("snapshot_ts"))
        found = parts.groupBy("exp_dir", "directory").agg(*[F.sum(c).alias(c) for c in TOTALS])
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_totals_follow_every_write_and_are_purged(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir, directory_sums=True)
    for t in range(3):
        catalog.snapshot_table(scan(spark, {("a", "x/f"): t, ("a", f"y/{t}"): 1}), snapshot_ts=f"t{t}")
        assert catalog.sum_directories() == 0
    builds = catalog.log.storage.children(catalog.sums.data_dir)
    assert len(builds) == 3
    expected = catalog.get_stats()
    catalog.consolidate(snapshot_ts="t9")
    catalog.purge(timedelta(0))
    left = catalog.log.storage.children(catalog.sums.data_dir)
    assert len(left) == 1 and left == catalog.log.storage.children(catalog.sums.index_dir)
    assert catalog.get_stats() == expected
    assert all("/sums/" in f for f in catalog.stats().inputFiles())


def test_listings_read_totals_and_trees_few_files(spark, catalog_dir, monkeypatch):
    monkeypatch.setattr(log, "ROWS_PER_TASK", 50)
    table = spark.range(1000).select(
        F.format_string("/d/a/run%03d/sub/f%05d", F.col("id") % 40, F.col("id")).alias("path"),
        F.lit("a").alias("experiment"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"),
    )
    catalog = Catalog(spark, catalog_dir, directory_sums=True)
    catalog.snapshot_table(from_table(table), snapshot_ts="t0")
    assert len(catalog.files().inputFiles()) > 10
    for frame in (catalog.ls_dirs("/d/a"), catalog.stats(), catalog.directory_totals("/d")):
        assert frame.inputFiles() and all("/sums/" in f for f in frame.inputFiles())
    nodes = catalog.tree_nodes("/d/a", 2)
    assert all("/sums/" in f for f in nodes.inputFiles())
    assert nodes.count() == 80
    deep = catalog.tree_nodes("/d/a/run001", 2)
    assert 1 <= sum("/log/" in f for f in deep.inputFiles()) <= 2
    assert deep.filter("NOT is_dir").count() == 25


def test_a_build_without_its_index_counts_for_nothing(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir, directory_sums=True)
    catalog.snapshot_table(scan(spark, {("a", "x/f"): 7}), snapshot_ts="t0")
    catalog.log.storage.delete(catalog.sums.index_dir)
    assert catalog.get_stats()["total_size"] == 7
    assert catalog.sum_directories() == 1
    assert catalog.get_stats()["total_size"] == 7
    # Two builders at once: either build alone counts.
    catalog.log.storage.delete(catalog.sums.index_dir)
    first = catalog.sums._builds
    catalog.sums._builds = lambda rows: {}
    catalog.sum_directories()
    catalog.sum_directories()
    catalog.sums._builds = first
    assert len(catalog.log.storage.children(catalog.sums.index_dir)) == 2
    assert catalog.get_stats()["total_size"] == 7


def test_an_empty_catalog(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir)
    assert catalog.sum_directories() == 0
    assert set(catalog.get_stats().values()) == {0}
    assert catalog.ls_dirs("/d").collect() == []

"""Writers that share a snapshot time, files that bases share, and which files are read."""

import glob
import importlib
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pathledger import Catalog, from_table
from pathledger.schema import BASE
from pathledger.sources.log import directory_zone, new_write, sort_key

log = importlib.import_module("pathledger.sources.log")


def rows(spark, exp_dir, n, size=1, start=0):
    table = spark.range(start, start + n).select(
        F.format_string("/d/%s/run%02d/f%05d", F.lit(exp_dir), F.col("id") % 20, F.col("id")).alias("path"),
        F.lit(exp_dir).alias("experiment"), F.lit(size).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"),
    )
    return from_table(table)


def state_of(catalog, **options):
    frame = catalog.current_state(**options).select("exp_dir", "path", "size", "on_disk")
    return sorted(map(tuple, frame.collect()))


def files_read(frame):
    return {f.rsplit("/", 1)[1] for f in frame.inputFiles()}


def test_experiments_may_share_a_snapshot_time(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir)
    catalog.snapshot_table(rows(spark, "a", 5), snapshot_ts="t1")
    catalog.snapshot_table(rows(spark, "b", 3), snapshot_ts="t1")
    assert catalog.count() == 8
    # Neither a write without changes nor a refused one touches what another committed at its time.
    catalog.snapshot_table(rows(spark, "a", 5, size=2), snapshot_ts="t2")
    catalog.snapshot_table(rows(spark, "b", 3), snapshot_ts="t2")
    assert catalog.total_size() == 13
    refused = catalog.snapshot_table(rows(spark, "b", 1), snapshot_ts="t2", max_removed_fraction=0.1)
    assert refused[0].error and catalog.total_size() == 13
    # A base and a delta in one write, and a refused one among committed ones.
    table = rows(spark, "a", 5, size=3).unionByName(rows(spark, "b", 1)).unionByName(rows(spark, "c", 2))
    report = catalog.snapshot_table(table, snapshot_ts="t3", max_removed_fraction=0.1)
    assert [(c.exp_dir, bool(c.error)) for c in report] == [("a", False), ("b", True), ("c", False)]
    assert catalog.total_size() == 20 and catalog.count(on_disk_only=True) == 10


def test_writers_at_one_time(spark, catalog_dir):
    def record(i):
        return Catalog(spark, catalog_dir).snapshot_table(rows(spark, f"e{i}", i + 1), snapshot_ts="2020-01-01")[0].added

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(record, range(6))) == [1, 2, 3, 4, 5, 6]
    assert Catalog(spark, catalog_dir).count() == 21


def test_purge_spares_a_running_write(spark, catalog_dir, monkeypatch):
    """Data may be dated long ago; a write began when it began."""
    catalog = Catalog(spark, catalog_dir)
    catalog.snapshot_table(rows(spark, "a", 4), snapshot_ts="2020-01-01T000000.000000")
    commit = catalog.log.commit
    monkeypatch.setattr(catalog.log, "commit", lambda actions: (catalog.purge(), commit(actions)))
    catalog.snapshot_table(rows(spark, "b", 4), snapshot_ts="2020-01-01T000000.000000")
    monkeypatch.undo()
    assert catalog.count() == 8
    # What was never committed goes once it is old enough.
    write = new_write()
    catalog.log.write_base(rows(spark, "c", 2).withColumns(
        {"indexed_at": F.lit("t"), "on_disk": F.lit(True), "status": F.lit(None).cast("string")}), write, "t", 2)
    catalog.log.measure_base(write, "t")
    catalog.purge()
    assert os.path.isdir(catalog.log.folder(write))
    catalog.purge(timedelta(0))
    assert not os.path.exists(catalog.log.folder(write)) and len(os.listdir(f"{catalog_dir}/zones")) == 2
    assert catalog.count() == 8


@pytest.fixture
def in_files(monkeypatch):
    monkeypatch.setattr(log, "ROWS_PER_TASK", 100)


def test_listing_opens_only_files_of_its_directory(spark, catalog_dir, in_files):
    catalog = Catalog(spark, catalog_dir)
    catalog.snapshot_table(rows(spark, "a", 2000), snapshot_ts="t0")
    everything = files_read(catalog.files())
    assert len(everything) >= 15
    assert len(files_read(catalog.ls("/d/a/run07"))) <= 3
    assert catalog.ls("/d/a/run07").count() == 100
    assert catalog.ls("/d/a").count() == 0
    assert files_read(catalog.ls_dirs("/d/a")) == everything
    assert catalog.ls_dirs("/d/a").count() == 20
    assert len(files_read(catalog.ls_dirs("/d/a/run07"))) <= 3
    # With deltas on top.
    catalog.snapshot_table(rows(spark, "a", 1990, size=2, start=10), snapshot_ts="t1")
    listed = catalog.ls("/d/a/run07").collect()
    assert len(listed) == 100 and sum(r.size for r in listed) == 199 and sum(r.on_disk for r in listed) == 99
    assert [(r.dirname, r.file_count) for r in catalog.ls_dirs("/d/a").collect()][7] == ("run07", 100)


def test_zones_of_directories(spark):
    parents = ["/", "/a", "/a-b", "/a/b", "/a/b c", "/a0", "/b", "."]
    frame = spark.createDataFrame([(p, f) for p in parents for f in ("", "x", "\U0001f600")], "p string, f string")
    for path, direct, inside in [
        ("/a", True, {"/a"}), ("/a", False, {"/a", "/a/b", "/a/b c", "/a-b"}), ("/a/", False, {"/a", "/a/b", "/a/b c", "/a-b"}),
        ("/", False, {"/", "/a", "/a-b", "/a/b", "/a/b c", "/a0", "/b", "."}), ("/", True, {"/"}), (".", True, {"."}),
    ]:
        zone = directory_zone(path, direct)
        key = sort_key(F.col("p"), F.col("f"))
        found = {r.p for r in frame.filter((key >= zone.low) & (key < zone.high)).collect()}
        assert found == inside, path


def bytes_of(folder):
    return {f: os.path.getsize(os.path.join(d, f)) for d, _, found in os.walk(folder) for f in found if f.endswith(".parquet")}


def test_compaction_rewrites_only_what_deltas_meet(spark, catalog_dir, tmp_path, in_files):
    catalog = Catalog(spark, catalog_dir)
    catalog.snapshot_table(rows(spark, "a", 4000).unionByName(rows(spark, "b", 50)), snapshot_ts="t0")
    before = bytes_of(f"{catalog_dir}/log")
    # One directory changes, one file is new beyond all others, one goes.
    changed = rows(spark, "a", 4000).withColumn(
        "size", F.when(F.col("parent_path") == "/d/a/run05", 9).otherwise(F.col("size"))
    ).filter("filename <> 'f00025'").unionByName(rows(spark, "a", 1, start=99_999))
    report = catalog.snapshot_table(changed, targets=[("a", None)], snapshot_ts="t1")
    assert tuple(report[0])[1:4] == (1, 199, 1)
    expected = state_of(catalog)
    planned = catalog.files()
    assert catalog.consolidate(str(tmp_path / "old"), snapshot_ts="t2")["experiments"] == 1
    base = [s for s in catalog.log.listed(catalog.log.snapshots()) if s.exp_dir == "a"]
    assert [(s.kind, s.shared, s.n_records) for s in base] == [(BASE, True, 4001)]
    zones = catalog.log.zones([log.as_snapshot(base[0])]).collect()
    new = sum(z.n_bytes for z in zones if z.at_write == base[0].write)
    assert 0 < new < 0.15 * sum(before.values())
    assert sum(z.n_records for z in zones) == 4001 == base[0].n_records
    assert state_of(catalog) == expected and planned.count() == 4051
    # The old snapshots go; files that the new base shares stay, for all ways of reading.
    assert catalog.purge(timedelta(0)) == 2
    assert state_of(catalog) == expected
    assert set(bytes_of(f"{catalog_dir}/log")) >= {z.name for z in zones}
    assert len(bytes_of(f"{catalog_dir}/log")) < len(before) + len(zones)
    assert catalog.ls("/d/a/run05").count() == 200 and catalog.ls("/d/a/run06").count() == 200
    archived = spark.read.parquet(str(tmp_path / "old")).groupBy("snapshot_ts").count().collect()
    assert {(r.snapshot_ts, r["count"]) for r in archived} == {("t0", 4000), ("t1", 201)}
    # Again, on a base of which most files are shared.
    catalog.snapshot_table(rows(spark, "a", 4000).filter("filename <> 'f03999'"), targets=[("a", None)], snapshot_ts="t3")
    expected = state_of(catalog)
    catalog.consolidate(str(tmp_path / "old"), snapshot_ts="t4")
    assert state_of(catalog) == expected
    assert catalog.purge(timedelta(0)) == 2 and state_of(catalog) == expected
    archived = spark.read.parquet(str(tmp_path / "old")).groupBy("snapshot_ts").count().collect()
    assert {(r.snapshot_ts, r["count"]) for r in archived} >= {("t0", 4000), ("t1", 201), ("t2", 4001)}
    assert catalog.fold_commits() > 1 and state_of(catalog) == expected


def test_an_inventory_is_evaluated_once(spark, catalog_dir, in_files):
    """Counting, range bounds, write and diff all read the staged table."""
    catalog = Catalog(spark, catalog_dir)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for size, times in ((1, 1), (2, 2)):
        given = rows(spark, "a", 1000, size=size).unionByName(rows(spark, f"b{size}", 500))
        catalog.snapshot_table(given.mapInArrow(counted, given.schema), snapshot_ts=f"t{size}", targets=[("a", None), (f"b{size}", None)])
        assert seen.value == 1500 * times
    assert catalog.total_size() == 1000 * 2 + 500 + 500
    assert not glob.glob(f"{catalog_dir}/_staging/*")


def test_a_delta_counts_itself(spark, catalog_dir, monkeypatch):
    """Observed while written, and equal to what reading it back counts."""
    catalog = Catalog(spark, catalog_dir)
    catalog.snapshot_table(rows(spark, "a", 300).unionByName(rows(spark, "b", 20)), snapshot_ts="t0")
    changed = rows(spark, "a", 200, size=5).unionByName(rows(spark, "a", 30, start=900)).unionByName(
        rows(spark, "b", 20, size=2).withColumn("experiment", F.lit(None).cast("string"))
    )
    read_back, counted = catalog.log.measure_delta, []
    monkeypatch.setattr(catalog.log, "measure_delta", lambda *place: counted.append(place) or read_back(*place))
    report = catalog.snapshot_table(changed, snapshot_ts="t1")
    assert [tuple(c)[:4] for c in report] == [("a", 30, 200, 100), ("b", 0, 20, 0)] and not counted
    committed = [s for s in catalog.log.commits().filter("kind = 'delta'").collect()]
    again = {r.exp_dir: r.asDict() for r in read_back(committed[0].write, "t1")}
    for row in committed:
        assert {c: row[c] for c in again[row.exp_dir]} == again[row.exp_dir]
    monkeypatch.setattr(log, "OBSERVED", 1)
    catalog.snapshot_table(rows(spark, "a", 2).unionByName(rows(spark, "b", 2)), snapshot_ts="t2")
    assert len(counted) == 1 and catalog.count(on_disk_only=True) == 4

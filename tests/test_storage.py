"""Catalogs on storage: both layouts, both ways of reading, batch index, failures."""

import importlib
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathledger import Catalog, FlatCatalog, from_table
from pathledger import operators as ops
from pathledger.schema import COMMIT_SCHEMA, FILE_SCHEMA, KEY
from pathledger.sources import scan_roots
from pathledger.sources.local import local_frame
from pathledger.sources.log import new_write
from pathledger.sources.storage import Staging
from tests.conftest import TESTDATA, write_file
from tests.test_operators import fold, log_rows, random_history
from workload import relations as rel

consolidation = importlib.import_module("pathledger.plans.consolidate")


def state_of(frame):
    columns = ("exp_dir", "path", "size", "indexed_at", "on_disk")
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def recorded(spark):
    catalog, _ = rel.recorded(spark, TESTDATA)
    return catalog


def test_all_ways_of_reading_agree(spark, recorded):
    expected = state_of(rel.files(spark, TESTDATA))
    root = recorded.log.root
    listed = [(s, b) for s in ("auto", "merge", "replay") for b in (0, 10**9)]
    for strategy, limit in listed:
        catalog = Catalog(spark, root, strategy, broadcast_bytes=limit)
        assert state_of(catalog.current_state()) == expected, (strategy, limit)
    some = recorded.current_state(["cxi00001", "xpp00002"])
    assert {r.exp_dir for r in some.select("exp_dir").distinct().collect()} == {"cxi00001", "xpp00002"}


def test_broadcast_only_within_its_bound(spark, recorded):
    def plan(**options):
        catalog = Catalog(spark, recorded.log.root, **options)
        # The planner's own size estimate must not decide here.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            frame = catalog.current_state()
            return frame._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert "BroadcastHashJoin" in plan()
    assert "BroadcastHashJoin" not in plan(broadcast_bytes=1000)
    assert "Window" in plan(broadcast_bytes=1000)


def test_filters_reach_the_scan(spark, recorded):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)

    def scans(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.split("\n") if "FileScan" in line]

    listed = scans(recorded.ls("/ds/cxi/cxi00004/results"))
    assert listed and all("StringStartsWith(path,/ds/cxi/cxi00004/results/)" in s for s in listed)
    found = scans(recorded.find("%.h5", experiment="cxi00004"))
    # Its base, once more for the keys that deltas end, and its few deltas.
    assert 4 <= len(found) <= 6 and all("StringEndsWith(path,.h5)" in s for s in found)
    narrow = recorded.files().agg(F.sum("size"))
    for line in scans(narrow):
        assert "owner" not in line and "checksum" not in line and "filename" not in line


def test_consolidated_view_and_copying_archive(spark, tmp_path, monkeypatch):
    catalog, _ = rel.record_scans(spark, TESTDATA)
    before = state_of(catalog.current_state())
    snapshots = catalog.list_snapshots().count()
    expected = catalog.log.read_log().join(
        catalog.list_snapshots().filter("type = 'delta'").select(F.col("experiment").alias("exp_dir")).distinct(),
        "exp_dir",
    ).count()
    # The first attempt fails after its commit, the second finishes the archive.
    with monkeypatch.context() as patch:
        patch.setattr(consolidation, "_copy", lambda *_: 1 / 0)
        planned = catalog.current_state()
        with pytest.raises(ZeroDivisionError):
            catalog.consolidate(str(tmp_path / "old"), snapshot_ts="t3")
    assert state_of(catalog.current_state()) == before == state_of(planned)
    stats = catalog.consolidate(str(tmp_path / "old"), snapshot_ts="t3")
    assert stats["experiments"] == 0
    archived = spark.read.schema(catalog.log.read_log().schema).parquet(str(tmp_path / "old"))
    assert archived.count() == expected
    changing = {p.name for p in (tmp_path / "old").glob("exp_dir=*")}
    assert stats["files_archived"] == 3 * len(changing)
    assert catalog.list_snapshots().count() == snapshots - 2 * len(changing)
    assert catalog.purge() == 0
    assert state_of(planned) == before
    assert catalog.purge(timedelta(0)) == 3 * len(changing)
    assert state_of(catalog.current_state()) == before
    assert catalog.fold_commits() > 1 and catalog.fold_commits() == 0
    assert state_of(catalog.current_state()) == before


def test_plans_do_not_grow_with_the_number_of_snapshots(spark, catalog_dir):
    """Three thousand snapshots are read by as many scans as three."""
    catalog = Catalog(spark, catalog_dir)
    rows = from_table(spark.sql("SELECT '/a' AS path, 'e' AS experiment, 1L AS size, 1L AS mtime"))
    catalog.snapshot_table(rows, snapshot_ts="t0")
    catalog.snapshot_table(rows.withColumn("size", F.lit(2)), snapshot_ts="t1")

    def scans():
        frame = catalog.files()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan"), frame.count()

    few = scans()
    place = [f"more{i}" for i in range(3000)]
    for name in place:
        os.makedirs(f"{catalog_dir}/log/write=w/snapshot_ts=t2/kind=base/exp_dir={name}")
    commits = [("add", n, "base", "t2", None, 0, 0, 0, 0, 0, 0, None, "w", 0, False, None) for n in place]
    catalog.log.commit(local_frame(spark, commits, COMMIT_SCHEMA))
    many = scans()
    assert many[0] == few[0] + 1  # experiments without deltas are one scan more
    assert many[1] == few[1]


def test_writers_of_different_experiments_do_not_lose_commits(spark, catalog_dir):
    def record(i):
        rows = from_table(spark.sql(f"SELECT '/{i}' AS path, 'e{i}' AS experiment, 1L AS size, 1L AS mtime"))
        return Catalog(spark, catalog_dir).snapshot_table(rows)[0].added

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(record, range(8))) == [1] * 8
    assert Catalog(spark, catalog_dir).count() == 8


def test_what_would_never_be_read_is_refused(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir)
    table = spark.sql("SELECT '/a' AS path, 1L AS size, 1L AS mtime")
    with pytest.raises(ValueError, match="needs exp_dir"):
        from_table(table)
    with pytest.raises(ValueError, match="without exp_dir"):
        catalog.snapshot_table(from_table(table.withColumn("exp_dir", F.lit(None).cast("string"))))
    rows = from_table(table, root="/")
    catalog.snapshot_table(rows, snapshot_ts="t5")
    with pytest.raises(ValueError, match="t4 is not after t5"):
        catalog.snapshot_table(rows.withColumn("size", F.lit(9)), snapshot_ts="t4")
    other = from_table(table.withColumns({"exp_dir": F.lit("a:b"), "experiment": F.lit("e")}))
    catalog.snapshot_table(other, snapshot_ts="t6")
    assert catalog.find("%", experiment="e").count() == 1
    assert all(os.path.isdir(r.file) for r in catalog.list_snapshots().collect())


def test_unreadable_parts_are_not_removed(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir)
    paths = ["/r/keep", "/r/closed/a", "/r/closed/b/c", "/r/closedx/d", "/r/one"]
    table = spark.createDataFrame([(p, "e", 1, 1) for p in paths], "path string, experiment string, size long, mtime long")
    target = [("e", "/r")]
    catalog.snapshot_table(from_table(table), targets=target)
    seen = from_table(table.filter("path = '/r/keep'"))

    def errors(*found):
        return spark.createDataFrame([("e", p, "denied") for p in found], "exp_dir string, path string, error string")

    change = catalog.snapshot_table(seen, targets=target, errors=errors("/r"))[0]
    assert (change.removed, change.error) == (0, "unreadable root: /r")
    change = catalog.snapshot_table(seen, targets=target, errors=errors("/r/closed", "/r/one"))[0]
    assert change.removed == 1 and change.error is None
    assert [r.path for r in catalog.find("%", removed_only=True).collect()] == ["/r/closedx/d"]


def test_one_name_in_two_hutches(spark, tmp_path, catalog_dir):
    write_file(tmp_path / "data/cxi/common/a", 1)
    write_file(tmp_path / "data/mfx/common/b", 2)
    catalog = Catalog(spark, catalog_dir)
    report = catalog.index(str(tmp_path / "data"), ["cxi", "mfx"]).collect()
    assert sorted((r.hutch, r.added) for r in report) == [("cxi", 1), ("mfx", 1)]
    for hutch, name in (("cxi", "a"), ("mfx", "b")):
        assert [r.filename for r in catalog.ls(f"{tmp_path}/data/{hutch}/common").collect()] == [name]


def test_uncommitted_files_stay_invisible(spark, catalog_dir):
    catalog = Catalog(spark, catalog_dir)
    rows = from_table(spark.sql("SELECT 'e' AS experiment, '/a' AS path, 1L AS size, 1L AS mtime"))
    catalog.snapshot_table(rows, snapshot_ts="t0")
    more = rows.withColumns(
        {"indexed_at": F.lit("t1"), "on_disk": F.lit(None).cast("boolean"), "status": F.lit("removed")}
    )
    catalog.log.write_delta(more, new_write(), "t1")
    assert catalog.count(on_disk_only=True) == 1 and catalog.list_snapshots().count() == 1
    with pytest.raises(ValueError, match="is not after"):
        catalog.snapshot_table(rows, snapshot_ts="t0")
    changed = rows.withColumn("size", F.lit(5))
    assert catalog.snapshot_table(changed, snapshot_ts="t1")[0].modified == 1
    assert catalog.total_size() == 5


# -- flat layout ---------------------------------------------------------------------


def flat_file(root, exp_dir, name, rows, drop=()):
    """One snapshot file as another writer leaves it."""
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f for f in FILE_SCHEMA if f.name not in drop]
    columns = [
        pa.array([r.get(f.name) for r in rows], types[f.dataType.simpleString()]) for f in fields
    ]
    os.makedirs(root / exp_dir, exist_ok=True)
    pq.write_table(pa.table(columns, names=[f.name for f in fields]), root / exp_dir / name)


def flat_catalog(root, history):
    by_file = {}
    for e, p, size, _, ts, on_disk, status, kind, _ in log_rows(history):
        row = {"path": p, "size": size, "indexed_at": ts, "on_disk": on_disk, "status": status}
        row |= {"parent_path": p.rsplit("/", 1)[0], "filename": p.rsplit("/", 1)[1], "mtime": size}
        by_file.setdefault((e, f"{kind}_{ts}.parquet"), []).append(row)
    for (e, name), rows in by_file.items():
        flat_file(root, e, name, rows)


def test_flat_catalog_equals_the_fold(spark, tmp_path):
    history = random_history(5)
    flat_catalog(tmp_path, history)
    catalog = FlatCatalog(spark, str(tmp_path))
    assert state_of(catalog.current_state()) == fold(history)
    assert state_of(FlatCatalog(spark, str(tmp_path), "merge").current_state()) == fold(history)
    assert catalog.count() == len(fold(history))
    assert catalog.log.read_log().count() == len(history)
    listed = catalog.list_snapshots().collect()
    assert sum(r.record_count for r in listed) == len(history)
    assert {r.type for r in listed} == {"base", "delta"} and all(r.size_bytes > 0 for r in listed)
    assert all(os.path.exists(r.file.removeprefix("file:")) for r in listed)
    assert catalog.list_snapshots("e1").count() == sum(r.experiment == "e1" for r in listed)


def test_flat_catalog_with_odd_files(spark, tmp_path):
    odd = ["12e45678", "exp one", "_x", "a+b%20", "[q]"]
    for name in odd:
        row = {"path": f"/{name}/f", "parent_path": f"/{name}", "filename": "f", "size": 1}
        flat_file(tmp_path, name, "base_2024-01-01T000000.000000.parquet", [row], drop=("status", "run"))
        # An older base, a delta before the base and a left-over are not current.
        flat_file(tmp_path, name, "base_2023-01-01T000000.000000.parquet", [row | {"size": 9}])
        flat_file(tmp_path, name, "delta_2023-06-01T000000.000000.parquet", [row | {"status": "removed"}])
        flat_file(tmp_path, name, "delta_2024-02-01.parquet.tmp", [row | {"status": "removed"}])
    flat_file(tmp_path, "only_delta", "delta_2024-01-01.parquet", [row | {"status": "added"}])
    state = FlatCatalog(spark, str(tmp_path)).current_state()
    got = sorted(tuple(r) for r in state.select("exp_dir", "path", "size", "on_disk").collect())
    assert got == sorted((n, f"/{n}/f", 1, True) for n in odd)
    empty = tmp_path / "empty"
    empty.mkdir()
    assert FlatCatalog(spark, str(empty)).get_stats()["total_count"] == 0


# -- inventories, batch index, scan ----------------------------------------------------


def test_any_table_is_an_inventory(spark):
    table = spark.sql("SELECT '/d/run7/x.h5' AS path, 5 AS size, 6 AS mtime, 'u' AS owner")
    row = from_table(table, root="/d").first()
    assert (row.parent_path, row.filename, row.run, row.owner) == ("/d/run7", "x.h5", 7, "u")
    assert row.checksum is None and len(row.exp_dir) == 8
    assert set(KEY) < set(from_table(table, root="/d").columns)


def test_batch_index(spark, tmp_path, catalog_dir):
    data = tmp_path / "data"
    for name, size in {"cxi/cxi1/a": 1, "cxi/cxi1/run2/b": 2, "cxi/cxi2/c": 3, "mfx/mfx1/d": 4}.items():
        write_file(data / name, size)
    write_file(data / "cxi/loose_file", 9)
    write_file(data / "cxi/.hidden/x", 9)
    os.symlink("/nonexistent", data / "mfx/mfx1/link")
    catalog = Catalog(spark, catalog_dir)
    hutches = ["cxi", "mfx", "xcs"]
    counts = catalog.dry_run(str(data), hutches).collect()
    assert sorted(map(tuple, counts)) == [("cxi", "cxi1", 2), ("cxi", "cxi2", 1), ("mfx", "mfx1", 1)]
    assert catalog.list_snapshots().count() == 0

    def report():
        rows = catalog.index(str(data), hutches).collect()
        assert [(r.hutch, r.experiment, bool(r.error)) for r in rows if r.hutch == "xcs"] == [("xcs", None, True)]
        return sorted(tuple(r)[:5] for r in rows if r.hutch != "xcs")

    assert report() == [
        ("cxi", "cxi1", 2, 0, 0), ("cxi", "cxi2", 1, 0, 0), ("mfx", "mfx1", 2, 0, 0),
    ]
    write_file(data / "cxi/cxi1/a", 100)
    (data / "mfx/mfx1/d").unlink()
    write_file(data / "mfx/mfx2/new", 5)
    assert report() == [
        ("cxi", "cxi1", 0, 1, 0), ("cxi", "cxi2", 0, 0, 0), ("mfx", "mfx1", 0, 0, 1), ("mfx", "mfx2", 1, 0, 0),
    ]
    found = catalog.query("SELECT experiment, COUNT(*) n FROM files WHERE on_disk GROUP BY 1 ORDER BY 1")
    assert [tuple(r) for r in found.collect()] == [("cxi1", 2), ("cxi2", 1), ("mfx1", 1), ("mfx2", 1)]


def test_one_failing_experiment_of_a_batch(spark, tmp_path, catalog_dir, monkeypatch):
    batch = importlib.import_module("pathledger.plans.batch")
    for i in range(4):
        write_file(tmp_path / f"data/cxi/e{i}/f", i)
    real, calls = batch.record_snapshot, []

    def record(store, files, targets, *args, **options):
        calls.append(sorted(e for e, _ in targets))
        if "e2" in calls[-1]:
            # Half-way: files written, nothing committed.
            rows = files.withColumns({"indexed_at": F.lit("t"), "on_disk": F.lit(True), "status": F.lit(None).cast("string")})
            store.write_base(rows, options["write"], "t", 1)
            raise OSError("disk full")
        return real(store, files, targets, *args, **options)

    monkeypatch.setattr(batch, "record_snapshot", record)
    catalog = Catalog(spark, catalog_dir)
    report = {r.experiment: (r.added, r.error) for r in catalog.index(str(tmp_path / "data"), ["cxi"]).collect()}
    assert report == {"e0": (1, None), "e1": (1, None), "e2": (0, "OSError: disk full"), "e3": (1, None)}
    assert calls == [["e0", "e1", "e2", "e3"], ["e0", "e1"], ["e2", "e3"], ["e2"], ["e3"]]
    assert sorted(r.experiment for r in catalog.list_snapshots().collect()) == ["e0", "e1", "e3"]
    # No folder of a write that failed is left.
    assert len(catalog.log.storage.children(catalog.log.log_dir)) == 2


def test_scan_of_wide_and_deep_trees(spark, tmp_path):
    for i in range(60):
        write_file(tmp_path / "wide" / f"d{i % 20}" / f"s{i % 7}" / f"f{i}", i)
    write_file(tmp_path.joinpath("deep", *["n"] * 30, "bottom"), 1)
    os.makedirs(tmp_path / "deep" / "closed")
    roots = [("w", "w", str(tmp_path / "wide")), ("d", None, str(tmp_path / "deep"))]
    with Staging(spark, str(tmp_path / "stage")) as staging:
        scan = scan_roots(spark, roots, staging, workers=3, batch_size=7)
        got = {(r.exp_dir, r.path, r.size) for r in scan.files.collect()}
        assert scan.errors.count() == 0
    expected = {
        (top[0], os.path.join(folder, f), os.path.getsize(os.path.join(folder, f)))
        for top in ("wide", "deep")
        for folder, _, found in os.walk(tmp_path / top)
        for f in found
    }
    assert got == expected and len(got) == 61


def test_names_that_are_no_text_are_reported(spark, tmp_path):
    write_file(tmp_path / "t" / "good", 1)
    with open(os.fsencode(tmp_path / "t") + b"/bad\xff", "wb"):
        pass
    with Staging(spark, str(tmp_path / "stage")) as staging:
        scan = scan_roots(spark, [("t", None, str(tmp_path / "t"))], staging)
        assert [r.filename for r in scan.files.collect()] == ["good"]
        assert [r.error for r in scan.errors.collect()] == ["name is not UTF-8"]


def test_large_logs_get_partitions_by_their_rows(spark, recorded, monkeypatch):
    """With few rows per task, diff and replay spread out and shuffle each side once."""
    log = importlib.import_module("pathledger.sources.log")
    monkeypatch.setattr(log, "ROWS_PER_TASK", 100)
    expected = state_of(recorded.current_state())
    live = Catalog(spark, recorded.log.root, broadcast_bytes=0).log.live()
    assert live.n_rows == recorded.log.read_log().count()
    previous = live.state_by_key(live.n_rows)
    tasks = -(-live.n_rows // 100)
    assert state_of(previous) == expected == state_of(live.state("replay"))

    current = log.spread(previous.filter("on_disk").drop("on_disk"), live.n_rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        changes = ops.snapshot_diff(previous, current)
        plan = changes._jdf.queryExecution().executedPlan().toString()
        assert changes.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert all(f", {tasks})" in line for line in exchanges)
    assert len(exchanges) == 2

    catalog, report = rel.record_scans(spark, TESTDATA, broadcast_bytes=0)
    assert state_of(catalog.current_state()) == expected
    assert report == rel.recorded(spark, TESTDATA)[1]

"""End to end: real files are scanned, changed and scanned again."""

import glob
import hashlib
import os

import pytest

from pathledger import Catalog, from_table, write_tsv
from tests.conftest import EXPERIMENT_FILES, write_file


@pytest.fixture
def catalog(spark, catalog_dir):
    return Catalog(spark, catalog_dir)


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    """A catalog that tests only read, and its scanned root."""
    top = tmp_path_factory.mktemp("scanned")
    root = top / "exp" / "xpptest01"
    for name, size in EXPERIMENT_FILES.items():
        write_file(root / name, size)
    (root / "scratch" / "empty_run").mkdir()
    catalog = Catalog(spark, str(top / "catalog"))
    counts = catalog.snapshot(
        str(root), experiment="xpptest01", compute_checksum=True, workers=4, batch_size=2
    )
    assert counts == (6, 0, 0)
    return catalog, root


def names(frame):
    return [r.filename for r in frame.collect()]


def test_first_scan_makes_a_base(scanned):
    catalog, _ = scanned
    assert catalog.count() == 6
    assert catalog.total_size() == sum(EXPERIMENT_FILES.values())
    listed = catalog.list_snapshots().collect()
    assert [(r.experiment, r.type, r.record_count) for r in listed] == [("xpptest01", "base", 6)]
    assert listed[0].size_bytes > 0 and os.path.isdir(listed[0].file)


def test_rows_carry_all_metadata(scanned):
    catalog, root = scanned
    row = catalog.ls(f"{root}/scratch/run0001").first()
    info = os.lstat(root / "scratch/run0001/image_0001.h5")
    assert row.path == f"{root}/scratch/run0001/image_0001.h5"
    assert (row.size, row.mtime) == (1024, int(info.st_mtime))
    assert (row.owner, row.group_name) == (str(info.st_uid), str(info.st_gid))
    assert (row.permissions, row.run, row.experiment) == (info.st_mode, 1, "xpptest01")
    assert row.archive_uri is None and row.on_disk
    for row in catalog.find("%").collect():
        with open(row.path, "rb") as content:
            assert row.checksum == hashlib.sha256(content.read()).hexdigest()


def test_browsing(scanned):
    catalog, root = scanned
    expected = ["image_0001.h5", "image_0002.h5", "metadata.json"]
    assert names(catalog.ls(f"{root}/scratch/run0001")) == expected
    assert names(catalog.ls(f"{root}/scratch/run0001/")) == []
    for path in (str(root), f"{root}/"):
        found = [tuple(r) for r in catalog.ls_dirs(path).collect()]
        assert found == [("calib", 128, 1), ("results", 256, 1), ("scratch", 3684, 4)]
    assert catalog.find("%.h5").count() == 3
    assert catalog.find("%", size_gt=1000).count() == 2
    assert catalog.find("%", size_gt=1024, size_lt=2048).count() == 0
    assert catalog.find("%", exclude=["%.h5", "%.npz"]).count() == 2
    assert catalog.find("%", experiment="xpptest01").count() == 6
    assert catalog.find("%", experiment="other").count() == 0
    assert catalog.find("%", on_disk_only=True, removed_only=True).count() == 0


def test_sql_with_its_own_with(scanned):
    catalog, _ = scanned
    sql = "WITH big AS (SELECT * FROM files WHERE size > 200) SELECT COUNT(*) AS n FROM big"
    assert catalog.query(sql).first().n == 4
    assert len(catalog.query("SELECT * FROM files").columns) == 13


def test_tsv(scanned, tmp_path):
    catalog, _ = scanned
    out = tmp_path / "out"
    found = catalog.find("%.npz").select("filename", "size", "archive_uri")
    write_tsv(found, str(out))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert text == "analysis.npz\t256\t\n"


def test_life_of_files(catalog, experiment, tmp_path):
    root = str(experiment)
    catalog.snapshot(root)
    assert catalog.snapshot(root) == (0, 0, 0)
    assert catalog.list_snapshots().count() == 1

    write_file(experiment / "scratch/new_file.txt", 11)
    write_file(experiment / "results/analysis.npz", 300)
    (experiment / "scratch/run0001/metadata.json").unlink()
    assert catalog.snapshot(root) == (1, 1, 1)
    assert (catalog.count(), catalog.count(on_disk_only=True)) == (7, 6)
    removed = catalog.find("%", removed_only=True).collect()
    assert [r.filename for r in removed] == ["metadata.json"]
    assert removed[0].size == 100 and not removed[0].on_disk
    assert [r.purge_date for r in catalog.purge_dates().collect()] == [removed[0].indexed_at]

    write_file(experiment / "scratch/run0001/metadata.json", 50)
    assert catalog.snapshot(root) == (1, 0, 0)
    assert catalog.count(on_disk_only=True) == 7
    assert catalog.get_stats() == {
        "total_count": 7,
        "on_disk_count": 7,
        "total_size": 4068 + 11 + 44 - 50,
        "on_disk_size": 4068 + 11 + 44 - 50,
    }

    before = sorted(map(tuple, catalog.files().collect()), key=str)
    archive = str(tmp_path / "archive")
    stats = catalog.consolidate(archive)
    assert stats == {"experiments": 1, "files_removed": 0, "files_archived": 3}
    assert sorted(map(tuple, catalog.files().collect()), key=str) == before
    assert catalog.list_snapshots().count() == 1
    kept = [f for _, _, found in os.walk(archive) for f in found if f.endswith(".parquet")]
    assert len(kept) == 3
    assert catalog.consolidate() == {"experiments": 0, "files_removed": 0, "files_archived": 0}


def test_consolidation_keeps_removed_entries_and_times(catalog, experiment):
    catalog.snapshot(str(experiment))
    (experiment / "calib/calibration.dat").unlink()
    catalog.snapshot(str(experiment))
    gone = catalog.find("%", removed_only=True).first()
    assert catalog.consolidate()["files_removed"] == 2
    assert catalog.find("%", removed_only=True).first() == gone
    # A removed entry in a base comes back as added.
    write_file(experiment / "calib/calibration.dat", 128)
    assert catalog.snapshot(str(experiment)) == (1, 0, 0)
    assert catalog.count(on_disk_only=True) == 6


def test_tree(catalog, experiment):
    root = str(experiment)
    catalog.snapshot(root)
    write_file(experiment / "zz.txt", 5)
    (experiment / "calib/calibration.dat").unlink()
    catalog.snapshot(root)
    lines = [
        root,
        "├── results/ (1 files, 256.0 B)",
        "│   └── analysis.npz (256.0 B)",
        "├── scratch/ (4 files, 3.6 KB)",
        "│   ├── run0001/ (3 files, 3.1 KB)",
        "│   └── run0002/ (1 files, 512.0 B)",
        "└── zz.txt (5.0 B)",
    ]
    def drawn(depth):
        return [r.line for r in catalog.tree(root, depth).collect()]

    assert drawn(2) == lines
    assert drawn(0) == [root]
    deep = drawn(3)
    assert "│   │   ├── image_0001.h5 (1.0 KB)" in deep
    assert "│       └── data.h5 (512.0 B)" in deep
    assert len(drawn(1)) == 4


def test_empty_and_missing_roots(catalog, tmp_path, experiment):
    empty = tmp_path / "empty"
    empty.mkdir()
    assert catalog.snapshot(str(empty)) == (0, 0, 0)
    assert catalog.count() == 0 and catalog.files().collect() == []
    assert set(catalog.get_stats().values()) == {0}
    with pytest.raises(NotADirectoryError):
        catalog.snapshot(str(tmp_path / "missing"))
    # A known experiment whose tree became empty loses all its files.
    catalog.snapshot(str(experiment))
    for name in EXPERIMENT_FILES:
        (experiment / name).unlink()
    assert catalog.snapshot(str(experiment)) == (0, 0, 6)
    assert catalog.count(on_disk_only=True) == 0


def test_deep_tree_and_odd_names(catalog, tmp_path):
    deep = tmp_path / "deep"
    write_file(deep.joinpath(*[f"level{i:02d}" for i in range(12)], "deep_file.txt"), 64)
    odd = tmp_path / "odd"
    odd_names = [
        "dir with spaces/file with spaces.txt", "unicode/dätä_2024.h5", "dots/archive.tar.gz.bak",
        "hidden/.hidden_config", "100%_sure/a'b\"c.txt", "back\\slash/x.txt", "tab\there/y",
    ]
    for name in odd_names:
        write_file(odd / name, 7)
    assert catalog.snapshot(str(deep), experiment="xppdeep01") == (1, 0, 0)
    assert catalog.find("%/deep_file.txt").count() == 1
    assert catalog.snapshot(str(odd), experiment="odd one") == (7, 0, 0)
    found = catalog.find("%", experiment="odd one").collect()
    assert [r.path for r in found] == sorted(f"{odd}/{n}" for n in odd_names)
    assert catalog.find("%back\\slash/%").count() == 1
    assert names(catalog.ls(f"{odd}/100%_sure")) == ["a'b\"c.txt"]
    assert catalog.ls_dirs(f"{odd}/100%_sur").count() == 0


def test_odd_experiment_names(spark, catalog, tmp_path):
    odd = ["12e45678", "00000012", "_x", ".y", "a=b/c%d", "two words", "[z]*", "q'uote", "ü"]

    def scan(files):
        rows = [(e, f"/d/{i}/{f}", 1, 1) for i, e in enumerate(odd) for f in files]
        return from_table(spark.createDataFrame(rows, "experiment string, path string, size long, mtime long"))

    changes = catalog.snapshot_table(scan(["f", "g"]))
    assert [(c.exp_dir, c.added) for c in changes] == [(e, 2) for e in sorted(odd)]
    assert all(c.removed == 1 for c in catalog.snapshot_table(scan(["f"])))
    assert catalog.find("%", experiment="12e45678").count() == 2
    assert catalog.find("%", experiment="a=b/c%d", removed_only=True).count() == 1
    assert catalog.consolidate(str(tmp_path / "old"))["files_archived"] == 2 * len(odd)
    state = catalog.current_state()
    assert sorted(r.exp_dir for r in state.filter("on_disk").collect()) == sorted(odd)


def test_unnamed_experiment_is_named_by_its_root(catalog, experiment):
    catalog.snapshot(str(experiment))
    expected = hashlib.md5(os.path.realpath(experiment).encode()).hexdigest()[:8]
    listed = catalog.list_snapshots(expected).collect()
    assert [r.experiment for r in listed] == [expected]
    assert catalog.list_snapshots("other").count() == 0
    assert catalog.files().first().experiment is None


def test_links(catalog, linked):
    assert catalog.snapshot(str(linked), compute_checksum=True, workers=2) == (4, 0, 0)
    rows = {r.filename: r for r in catalog.find("%").collect()}
    assert set(rows) == {"original.dat", "to_file.dat", "broken.dat", "to_directory"}
    assert rows["broken.dat"].size == os.lstat(linked / "links/broken.dat").st_size
    content = hashlib.sha256(b"x" * 128).hexdigest()
    assert rows["original.dat"].checksum == rows["to_file.dat"].checksum == content
    assert rows["broken.dat"].checksum is None and rows["to_directory"].checksum is None
    assert names(catalog.find("%", skip_symlinks=True)) == ["original.dat"]


def test_two_roots_under_one_name(catalog, tmp_path):
    write_file(tmp_path / "a/one.txt", 1)
    write_file(tmp_path / "ab/two.txt", 2)
    assert catalog.snapshot(str(tmp_path / "a"), experiment="e") == (1, 0, 0)
    assert catalog.snapshot(str(tmp_path / "ab"), experiment="e") == (1, 0, 0)
    assert catalog.snapshot(str(tmp_path / "a"), experiment="e") == (0, 0, 0)
    assert catalog.count(on_disk_only=True) == 2
    catalog.consolidate()
    assert names(catalog.ls(str(tmp_path / "ab"))) == ["two.txt"]
    assert names(catalog.ls(str(tmp_path / "a"))) == ["one.txt"]


def test_listing_reads_only_related_experiments(catalog, tmp_path):
    for name in ("a/one.txt", "ab/two.txt", "c/d/three.txt"):
        write_file(tmp_path / name, 1)
    for name in ("a", "ab", "c"):
        catalog.snapshot(str(tmp_path / name), experiment=name)

    def near(path):
        return sorted(catalog.log.live(under=path).exp_dirs)

    assert near(str(tmp_path / "a")) == ["a"]
    assert near(f"{tmp_path}/c/d/") == ["c"]
    assert near(str(tmp_path)) == near("/") == ["a", "ab", "c"]
    assert near(str(tmp_path / "x")) == []
    assert names(catalog.ls(str(tmp_path / "c/d"))) == ["three.txt"]
    assert [r.dirname for r in catalog.ls_dirs(str(tmp_path)).collect()] == ["a", "ab", "c"]


def test_overlapping_roots_stay_apart_in_any_layout(catalog, experiment):
    catalog.snapshot(str(experiment), experiment="outer")
    catalog.snapshot(str(experiment / "scratch"), experiment="inner")
    assert catalog.count() == 10
    write_file(experiment / "scratch/new.txt", 1)
    catalog.snapshot(str(experiment), experiment="outer")
    assert catalog.count() == 11
    catalog.consolidate()
    assert catalog.count() == 11


def test_compared_columns(catalog, experiment):
    root = str(experiment)
    catalog.snapshot(root)
    os.chmod(experiment / "calib/calibration.dat", 0o600)
    assert catalog.snapshot(root) == (0, 0, 0)
    assert catalog.snapshot(root, compare=("size", "mtime", "permissions")) == (0, 1, 0)


def test_too_many_removals_are_refused(catalog, experiment):
    root = str(experiment)
    catalog.snapshot(root)
    for name in list(EXPERIMENT_FILES)[:5]:
        (experiment / name).unlink()
    with pytest.raises(RuntimeError, match="5 of 6"):
        catalog.snapshot(root, max_removed_fraction=0.5)
    assert catalog.count(on_disk_only=True) == 6
    assert catalog.snapshot(root, max_removed_fraction=0.9) == (0, 0, 5)


def test_nothing_is_left_behind(catalog, catalog_dir, experiment):
    catalog.snapshot(str(experiment))
    catalog.snapshot(str(experiment))
    assert sorted(os.listdir(catalog_dir))[-3:] == ["commits", "log", "zones"]
    assert not glob.glob(f"{catalog_dir}/_staging/*")
    written = [d for d, _, found in os.walk(f"{catalog_dir}/log") if any(f.endswith("parquet") for f in found)]
    assert len(written) == 1

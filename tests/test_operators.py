"""Diff, replay, views and search on small literal relations, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pathledger import operators as ops
from pathledger.operators.versions import merge_on_read, replay
from pathledger.sources.log import split_live
from tests.test_functions import printed

LOG = (
    "exp_dir string, path string, size long, mtime long, indexed_at string, on_disk boolean, "
    "status string, kind string, snapshot_ts string"
)


def as_set(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def log_rows(history):
    """(exp_dir, path, size, ts, status) with status None for base rows."""
    return [
        (e, p, s, s, ts, True if st is None else None, st, "base" if st is None else "delta", ts)
        for e, p, s, ts, st in history
    ]


def fold(history):
    """Replay of rows in time order, one at a time."""
    state = {}
    for e, p, s, ts, st in sorted(history, key=lambda r: r[3]):
        if st == "removed":
            if (e, p) in state:
                state[e, p] = (state[e, p][0], ts, False)
        else:
            state[e, p] = (s, ts, True)
    return sorted((*k, *v) for k, v in state.items())


def random_history(seed, snapshots=6, paths=40):
    """Logs as a writer makes them: removals only of known files, with their metadata."""
    generator = random.Random(seed)
    history, state = [], {}
    for n in range(snapshots):
        for e in ("e1", "e2"):
            for i in range(paths):
                key, roll = (e, f"/{e}/f{i}"), generator.random()
                if n == 0:
                    if roll < 0.6:
                        state[key] = [i, True]
                        history.append((*key, i, "t0", None))
                elif key in state and state[key][1] and roll < 0.15:
                    state[key][1] = False
                    history.append((*key, state[key][0], f"t{n}", "removed"))
                elif roll > 0.85:
                    known = key in state and state[key][1]
                    state[key] = [i + 100 * n, True]
                    history.append((*key, i + 100 * n, f"t{n}", "modified" if known else "added"))
    return history


COLUMNS = ("exp_dir", "path", "size", "indexed_at", "on_disk")


@pytest.mark.parametrize("seed", [1, 2])
def test_every_view_equals_the_fold(spark, seed):
    history = random_history(seed) + [("quiet", f"/q/{i}", i, "t0", None) for i in range(5)]
    log = spark.createDataFrame(log_rows(history), LOG)
    bases, deltas = log.filter("kind = 'base'"), log.filter("kind = 'delta'")
    expected = fold(history)
    assert as_set(replay(log), *COLUMNS) == expected
    assert as_set(ops.files_view(log), *COLUMNS) == expected
    assert as_set(ops.files_view_selective(log, [e for e, *_ in history if e != "quiet"]), *COLUMNS) == expected
    assert as_set(merge_on_read(bases, deltas), *COLUMNS) == expected
    assert as_set(merge_on_read(bases, deltas, broadcast_keys=True), *COLUMNS) == expected


def test_removal_of_an_unknown_path_is_ignored(spark):
    history = [("e", "/a", 1, "t0", None), ("e", "/b", 2, "t1", "removed")]
    log = spark.createDataFrame(log_rows(history), LOG)
    bases, deltas = log.filter("kind = 'base'"), log.filter("kind = 'delta'")
    assert as_set(replay(log), "path", "on_disk") == [("/a", True)]
    assert as_set(merge_on_read(bases, deltas), "path", "on_disk") == [("/a", True)]


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_replay_for_any_log(spark, seed):
    """Orphan removals, paths that come and go, and times that disagree with the snapshots' order."""
    rnd = random.Random(seed)
    rows = [("e", f"/{i}", i, "t0", None) for i in range(20)]
    for n in range(1, 5):
        for i in rnd.sample(range(30), 12):
            rows.append(("e", f"/{i}", 100 * n + i, f"t{n}", rnd.choice(["added", "modified", "removed"])))
    log = spark.createDataFrame(log_rows(rows), LOG)
    log = log.withColumn("indexed_at", F.when(F.length("path") % 2 == 0, "t9").otherwise(F.col("indexed_at")))
    bases, deltas = log.filter("kind = 'base'"), log.filter("kind = 'delta'")
    expected = as_set(replay(log), *COLUMNS)
    assert as_set(merge_on_read(bases, deltas), *COLUMNS) == expected
    assert as_set(merge_on_read(bases, deltas, broadcast_keys=True), *COLUMNS) == expected


def test_scope_of_deduplication(spark):
    history = [("e1", "/a", 1, "t0", None), ("e2", "/a", 2, "t1", None), ("e1", "/b", 3, "t1", "added")]
    log = spark.createDataFrame(log_rows(history), LOG)
    assert as_set(ops.files_view(log), "exp_dir", "path") == [("e1", "/a"), ("e1", "/b"), ("e2", "/a")]
    assert as_set(ops.files_view(log, ["path"]), "path", "size") == [("/a", 2), ("/b", 3)]


def test_equal_times_prefer_the_delta(spark):
    history = [("e", "/a", 1, "t0", None), ("e", "/a", 2, "t0", "modified")]
    log = spark.createDataFrame(log_rows(history), LOG)
    assert as_set(ops.files_view(log), "size") == [(2,)]


def test_live_snapshots(spark):
    rows = [
        ("a", "base", "t1"), ("a", "delta", "t2"), ("a", "base", "t3"), ("a", "delta", "t4"),
        ("b", "base", "t1"), ("c", "delta", "t9"),
    ]
    frame = spark.createDataFrame(rows, "exp_dir string, kind string, snapshot_ts string")
    live = [("a", "base", "t3"), ("a", "delta", "t4"), ("b", "base", "t1")]
    assert as_set(ops.live_snapshots(frame), "exp_dir", "kind", "snapshot_ts") == live
    assert as_set(ops.latest_base(frame), "exp_dir", "base_ts") == [("a", "t3"), ("b", "t1")]
    assert as_set(ops.deltas_after_base(frame), "exp_dir", "snapshot_ts") == [("a", "t4")]
    parts = split_live(frame.collect())
    assert sorted(tuple(r) for part in parts for r in part) == live
    assert [r.exp_dir for r in parts.settled] == ["b"]


STATE = "exp_dir string, path string, size long, mtime long, owner string, on_disk boolean"
SCAN = "exp_dir string, path string, size long, mtime long, owner string"
PREVIOUS = [
    ("e", "/same", 1, 1, "0", True), ("e", "/grown", 1, 1, "0", True), ("e", "/touched", 1, 1, "0", True),
    ("e", "/owned", 1, 1, "0", True), ("e", "/gone", 5, 6, "7", True), ("e", "/back", 1, 1, "0", False),
    ("e", "/still gone", 1, 1, "0", False), ("e", "/null", None, 1, "0", True),
    ("e", "/was null", None, 1, "0", True), ("f", "/same", 1, 1, "0", True),
]
CURRENT = [
    ("e", "/same", 1, 1, "0"), ("e", "/grown", 2, 1, "0"), ("e", "/touched", 1, 2, "0"),
    ("e", "/owned", 1, 1, "9"), ("e", "/back", 1, 1, "0"), ("e", "/new", 3, 3, "0"),
    ("e", "/null", None, 1, "0"), ("e", "/was null", 1, 1, "0"), ("f", "/same", 1, 1, "0"),
]


def test_diff(spark):
    previous = spark.createDataFrame(PREVIOUS, STATE)
    current = spark.createDataFrame(CURRENT, SCAN)
    changes = ops.snapshot_diff(previous, current)
    assert as_set(changes, "path", "size", "mtime", "owner", "status") == [
        ("/back", 1, 1, "0", "added"),
        ("/gone", 5, 6, "7", "removed"),
        ("/grown", 2, 1, "0", "modified"),
        ("/new", 3, 3, "0", "added"),
        ("/touched", 1, 2, "0", "modified"),
        ("/was null", 1, 1, "0", "modified"),
    ]
    assert tuple(ops.change_counts(changes).first()) == (2, 3, 1)
    assert as_set(ops.added_entries(previous, current), "path") == [("/new",)]
    assert as_set(ops.restored_entries(previous, current), "path") == [("/back",)]
    assert as_set(ops.removed_entries(previous, current), "path") == [("/gone",)]
    modified = [("/grown",), ("/touched",), ("/was null",)]
    assert as_set(ops.modified_entries(previous, current), "path") == modified
    by_owner = ops.snapshot_diff(previous, current, compare=("owner",))
    assert ("/owned", "modified") in as_set(by_owner, "path", "status")
    unchanged = previous.filter("on_disk").drop("on_disk")
    assert ops.snapshot_diff(previous, unchanged).count() == 0


FILES = (
    "path string, parent_path string, filename string, size long, mtime long, permissions int, "
    "experiment string, on_disk boolean, indexed_at string"
)


def file_rows(paths):
    return [
        (p, p.rsplit("/", 1)[0] or "/", p.rsplit("/", 1)[1], n, n, 0o100644, None, True, "t")
        for n, p in enumerate(paths, 1)
    ]


def drawn(entries, root, depth):
    """The tree drawn by recursion over all paths."""
    lines = [root]

    def build(path, indent, depth):
        if depth == 0:
            return
        top = path.rstrip("/") + "/"
        items = {}
        for p, size in entries:
            if p.startswith(top):
                name, _, rest = p[len(top):].partition("/")
                kind = 0 if rest else 1
                n, total = items.get((name, kind), (0, 0))
                items[name, kind] = (n + 1, total + size)
        ordered = sorted(items.items())
        for i, ((name, kind), (n, total)) in enumerate(ordered):
            last = i == len(ordered) - 1
            label = f"{name} ({printed(total)})" if kind else f"{name}/ ({n} files, {printed(total)})"
            lines.append(indent + ("└── " if last else "├── ") + label)
            if not kind:
                build(top + name, indent + ("    " if last else "│   "), depth - 1)

    build(root, "", depth)
    return lines


def test_tree_equals_recursion(spark):
    generator = random.Random(3)
    paths = {
        "/r/" + "/".join(generator.choice("ab_%Z é") for _ in range(generator.randrange(1, 6))) + f"/f{i % 4}"
        for i in range(60)
    } | {"/r/f", "/r/a!", "/rx/other", "/top"}
    rows = file_rows(sorted(paths))
    files = spark.createDataFrame(rows, FILES)
    entries = [(r[0], r[3]) for r in rows]
    for root, depth in (("/r", 1), ("/r", 3), ("/r", 9), ("/", 2)):
        lines = ops.tree_lines(ops.tree_nodes(files, root, depth), root).collect()
        assert [r.line for r in lines] == drawn(entries, root, depth), (root, depth)


def test_listing_the_root(spark):
    files = spark.createDataFrame(file_rows(["/a", "/d/b", "/d/e/c"]), FILES)
    assert as_set(ops.list_directory(files, "/"), "path") == [("/a",)]
    assert as_set(ops.list_directories(files, "/"), "dirname", "file_count") == [("d", 2)]


def test_find_conditions(spark):
    rows = file_rows(["/a/x.h5", "/a/y.H5", "/a/b_c.txt", "/a/b%c\\d.txt", "/a/line\nbreak"])
    files = spark.createDataFrame(rows, FILES)

    def found(*args, **conditions):
        return [r.path for r in ops.find(files, *args, **conditions).collect()]

    assert found("%.h5") == ["/a/x.h5"]
    assert found("/a/b_c%") == ["/a/b%c\\d.txt", "/a/b_c.txt"]
    assert found("%\\d%") == ["/a/b%c\\d.txt"]
    assert found("%break") == ["/a/line\nbreak"]
    assert found("%", exclude=["%.txt", "%.h5"]) == ["/a/line\nbreak", "/a/y.H5"]
    assert found("%", extension="txt") == ["/a/b%c\\d.txt", "/a/b_c.txt"]
    assert found("%", regex=r"\.[hH]5$") == ["/a/x.h5", "/a/y.H5"]
    assert found("%", fuzzy=("y.h5", 1)) == ["/a/x.h5", "/a/y.H5"]
    assert found("%", mtime_from=2, mtime_to=3) == ["/a/y.H5"]
    assert found("%", on_disk_only=True, removed_only=True) == []
    assert found("%", experiment="e") == []


def test_archive(spark):
    rows = [r[:7] + (i % 2 == 0, "t") for i, r in enumerate(file_rows(["/a", "/b", "/c", "/d"]))]
    files = spark.createDataFrame(rows, FILES)
    manifest = spark.createDataFrame(
        [("/b", "u1"), ("/b", "u2"), ("/c", "u3"), ("/zz", "u4")], "path string, archive_uri string"
    )
    located = ops.archive_locations(files, manifest)
    assert [tuple(r) for r in located.select("path", "archive_uri").orderBy("path").collect()] == [
        ("/a", None), ("/b", "u2"), ("/c", "u3"), ("/d", None),
    ]
    later = ops.archive_locations(located, manifest.filter("path = '/d'"))
    assert as_set(later.filter("path = '/b'"), "archive_uri") == [("u2",)]
    assert as_set(ops.restore_manifest(files, manifest), "path", "archive_uri") == [("/b", "u2")]
    assert as_set(ops.purge_dates(files), "path", "purge_date") == [("/b", "t"), ("/d", "t")]

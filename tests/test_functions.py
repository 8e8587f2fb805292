"""Scalar expressions on literal rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathledger import parse_size
from pathledger import functions as fn


def rows(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    frame = rows(spark, values, kind).select("i", expression(F.col("v")).alias("x"))
    return [r.x for r in frame.orderBy("i").collect()]


def test_path_parts(spark):
    paths = ["/a/b/c.txt", "/c.txt", "c.txt", "/a/b/", "/ä/ö ü"]
    assert apply(spark, paths, fn.parent_path) == ["/a/b", "/", ".", "/a/b", "/ä"]
    assert apply(spark, paths, fn.filename) == ["c.txt", "c.txt", "c.txt", "", "ö ü"]
    assert apply(spark, ["a.tar.gz", "none", ".h5", "x."], fn.extension) == ["gz", "", "h5", ""]


def test_run_number(spark):
    paths = ["/brun12/run0003", "/prune12/run0042/x", "/scratch/x", "/run99999999999/run1", "/RUN7", "/runs"]
    assert apply(spark, paths, fn.run_number) == [12, 42, None, None, None, None]


def test_exp_dir_name(spark):
    frame = spark.createDataFrame(
        [("e1", "/r"), ("", "/r"), (None, "/r")], "experiment string, root string"
    )
    got = frame.select(fn.exp_dir_name(F.col("experiment"), F.col("root")).alias("x")).collect()
    digest = hashlib.md5(b"/r").hexdigest()[:8]
    assert [r.x for r in got] == ["e1", digest, digest]


def test_child_name(spark):
    got = apply(spark, ["/a/b/c/d", "/a/b", "/a/bb"], lambda c: fn.child_name(c, "/a/"))
    assert got == ["b", "b", "bb"]


SIZES = {
    "1GB": 1024**3, "500mb": 500 * 1024**2, "1.5TB": 3 * 1024**4 // 2, " 12 ": 12, "7B": 7,
    "0.1KB": 102, "2 PB": 2 * 1024**5, "-3": -3, "1e3KB": 1024000, ".5KB": 512, "3.KB": 3072,
}
NOT_SIZES = ["", "GB", "1.5", "abc", "1XB", "1.2.3KB", "one KB"]


def test_parse_size(spark):
    assert {text: parse_size(text) for text in SIZES} == SIZES
    assert apply(spark, list(SIZES), fn.parse_size_column) == list(SIZES.values())
    assert apply(spark, NOT_SIZES, fn.parse_size_column) == [None] * len(NOT_SIZES)
    for text in NOT_SIZES:
        with pytest.raises(ValueError):
            parse_size(text)


def printed(size):
    """Size text by floating point, which is exact for these divisors."""
    units = ["B", "KB", "MB", "GB", "TB"]
    for unit in units:
        if abs(size) < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} PB"


def test_size_human(spark):
    generator = random.Random(7)
    sizes = [0, 1, -1, 1023, 1024, 1280, 1344, 1408, 1536, -1280, 1024**2 - 1, 1024**5, 5 * 1024**6 // 4]
    sizes += [generator.randrange(2**53) >> generator.randrange(53) for _ in range(3000)]
    sizes += [k * 1024**p // 4 for p in range(1, 6) for k in range(1, 400)]
    assert apply(spark, sizes, fn.size_human, "long") == [printed(s) for s in sizes]
    assert apply(spark, [None, 1], fn.size_human, "long") == ["N/A", "1.0 B"]


def test_link_and_presence_flags(spark):
    modes = [0o100644, 0o120777, 0o040755, None]
    assert apply(spark, modes, fn.is_symlink, "int") == [False, True, False, None]
    assert apply(spark, modes, fn.is_regular_file, "int") == [True, False, False, None]
    frame = spark.createDataFrame(
        [(True, None), (False, None), (None, "added"), (None, "removed"), (None, None), (False, "added")],
        "on_disk boolean, status string",
    )
    got = frame.select(fn.resolve_on_disk(F.col("on_disk"), F.col("status")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True, False, True, False]

"""A shared session, and small real directory trees to scan."""

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").appName("pathledger-tests")
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_file(path: Path, size: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)


# An experiment of six files, 4068 bytes.
EXPERIMENT_FILES = {
    "scratch/run0001/image_0001.h5": 1024,
    "scratch/run0001/image_0002.h5": 2048,
    "scratch/run0001/metadata.json": 100,
    "scratch/run0002/data.h5": 512,
    "results/analysis.npz": 256,
    "calib/calibration.dat": 128,
}


@pytest.fixture
def experiment(tmp_path) -> Path:
    root = tmp_path / "exp" / "xpp" / "xpptest01"
    for name, size in EXPERIMENT_FILES.items():
        write_file(root / name, size)
    (root / "scratch" / "empty_run").mkdir()
    return root


@pytest.fixture
def linked(tmp_path) -> Path:
    root = tmp_path / "exp" / "xpp" / "xpplinks01"
    write_file(root / "data" / "original.dat", 128)
    (root / "links").mkdir()
    os.symlink(root / "data" / "original.dat", root / "links" / "to_file.dat")
    os.symlink("/nonexistent/file.dat", root / "links" / "broken.dat")
    os.symlink(root / "data", root / "links" / "to_directory")
    return root


@pytest.fixture
def catalog_dir(tmp_path) -> str:
    return str(tmp_path / "catalog")

"""Tables between the steps of an operator, on storage that all executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; set here only in a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pathledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A new folder for the written tables of one run.

    A written table cuts lineage: a lost executor repeats no more than its own tasks.
    ``drop`` deletes a table that no later step reads; those that a returned, lazy
    result reads stay, as checkpoints do.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        self._written: dict[str, DataFrame] = {}

    def write(self, frame: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Write and read again; ``by`` names a column whose values get folders of their own."""
        place = f"{self.path}/{next(self._numbers)}"
        writer = frame.write.option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(place)
        written = self._spark.read.schema(frame.schema).parquet(place)
        written._scratch_place = place
        self._written[place] = written
        return written

    def drop(self, *frames: DataFrame) -> None:
        jvm = self._spark._jvm
        conf = self._spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_place)
            path.getFileSystem(conf).delete(path, True)
            self._written.pop(frame._scratch_place, None)

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Delete all tables written so far but those that a returned result reads."""
        places = {frame._scratch_place for frame in kept}
        self.drop(*[frame for place, frame in self._written.items() if place not in places])


def broadcast_few(written: DataFrame, most: int = 1 << 22) -> DataFrame:
    """A written table of one or two long columns, marked for broadcast while its rows are at most ``most``."""
    return F.broadcast(written) if written.count() <= most else written


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
